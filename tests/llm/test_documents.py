"""Operators over documents: odd and empty tables, and plain versions of what they compute."""

import gc
import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roundweave.llm import bpe, mixing, near_dedup, pii, quality, queries, substrings, token_counts, toxicity
from tests.conftest import SF, same_rows

WORDS = re.compile("[^\x20\x09-\x0d]+")
RANKS = queries.rank_file()

ALL = {
    "token_counts": lambda d, l: token_counts.count_tokens(d, *RANKS, edits=token_counts.sample_edits),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "quality": lambda d, l: quality.quality(d),
    "near_dedup": lambda d, l: near_dedup.near_duplicates(d),
    "pii": lambda d, l: pii.personal_data(d),
    "bpe": lambda d, l: bpe.bpe_encode(d, *RANKS),
    "substrings": lambda d, l: substrings.remove_repeats(d),
    "mixing": lambda d, l: mixing.mix_counts(d.select("doc_id", "source", mixing.word_count(d["text"]).alias("size"))),
    "sanitise": lambda d, l: pii.sanitise(d),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows(odd, labels, name):
    got = ALL[name](odd, labels)
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, (r["doc_id"] for r in odd.select("doc_id").collect())))


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(none, labels, name):
    assert ALL[name](none, labels).count() == 0


def test_filters_keep_columns(odd, none, labels):
    for rows in (toxicity.drop_toxic(odd, labels), near_dedup.drop_near_duplicates(odd), pii.sanitise(odd), mixing.mix(odd)):
        assert rows.columns == odd.columns
    assert mixing.mix(none).count() == toxicity.drop_toxic(none, labels).count() == near_dedup.drop_near_duplicates(none).count() == 0


def test_sanitise_keeps_all_other_columns(odd):
    """Only texts with personal data and their lengths change, whatever other columns are called."""
    before, after = (Counter(map(tuple, rows.collect())) for rows in (odd, pii.sanitise(odd)))
    ((old,), (new,)) = (list((a - b).elements()) for a, b in ((before, after), (after, before)))
    text, size = odd.columns.index("text"), odd.columns.index("n_chars")
    assert old[0] == 8 and new[text] == "<PHONE> <EMAIL> <IP> 4111111111111111" and new[size] == len(new[text])
    assert [v for i, v in enumerate(old) if i not in (text, size)] == [v for i, v in enumerate(new) if i not in (text, size)]


# token counts


def test_token_counts(spark, docs, texts):
    it = bpe.codec(*RANKS)
    n = lambda t: len(it.encode(t)) // 4
    for r in queries.op1_token_counts(spark, SF).collect():
        t = texts[r["doc_id"]]
        edits = token_counts.clipped([{"start": len(t) // 3, "end": len(t) // 3 + 7, "text": ""}, {"start": len(t) // 2, "end": len(t) // 2 + 3, "text": "2026 revised"}, {"start": len(t), "end": len(t), "text": "\n\nRevised text."}], len(t))
        new, at = "", 0
        for start, end, text in edits:
            new, at = new + t[at:start] + text, end
        new += t[at:]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (n(t), n(new), len(new))


def test_edits_of_all_kinds():
    import random

    rng, it = random.Random(5), bpe.codec(*RANKS)
    counts = token_counts.TokenCounts(it)
    letters = "aab' 'llx  \n\t1é日😀.'s,"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for k in range(400):
        body = text(rng.choice([0, 1, 5, 200, 3000] if k % 20 == 0 else [0, 1, 5, 60]))
        tree = token_counts.CountTree.of(body, counts)
        for _ in range(3):
            edits = [{"start": (s := rng.randint(0, len(body) + 2)), "end": s + rng.choice([0, 1, 9, 80]), "text": text(rng.choice([0, 1, 4, 300]))} for _ in range(rng.randint(0, 4))]
            body = tree.edit(body, token_counts.clipped(edits, len(body)), counts)
            assert tree.total == len(it.encode(body)) // 4 and tree.chars[1] == len(body)


def test_edits_are_found_by_descending_the_sums():
    tree = token_counts.CountTree([3, 0, 5, 2, 0], [1, 0, 1, 1, 0])
    ends = [3, 3, 8, 10, 10]
    assert [tree.ended(x) for x in range(-1, 12)] == [sum(e <= x for e in ends) for x in range(-1, 12)]
    assert [tree.begin_of(i) for i in range(5)] == [0, 3, 3, 8, 10] and tree.kept() == ([3, 5, 2], [1, 1, 1])


def test_going_on_from_a_kept_state(spark, docs, texts, monkeypatch):
    """Edits in rounds, from a table: counts stay exact, and what is encoded follows the edits and not the text."""
    it = bpe.codec(*RANKS)
    long = " ".join(f"word{i % 991} and, so {i}" for i in range(20_000))
    rows = [(1, long), (2, "short text"), (3, None), (4, long + " ends")]
    state = token_counts.token_state(spark.createDataFrame(rows, "doc_id long, text string"), *RANKS)
    want = {k: t or "" for k, t in rows}
    for n in range(3):
        at, new = 1000 * n + 7, f" new{n} text"
        one = F.when(F.col("doc_id") != 4, F.array(F.struct(F.lit(at).alias("start"), F.lit(at + 5).alias("end"), F.lit(new).alias("text"))))
        state = token_counts.update_tokens(state, *RANKS, edits=one).cache()
        want = {k: t if k == 4 else t[:at] + new + t[at + 5 :] for k, t in want.items()}
        for r in state.collect():
            assert (r["text"], r["n_tokens_edited"]) == (want[r["doc_id"]], len(it.encode(want[r["doc_id"]])) // 4)
            assert sum(r["leaf_chars"]) == len(r["text"]) and sum(r["leaf_tokens"]) == r["n_tokens_edited"]
            assert r["n_encoded"] == 0 if r["doc_id"] == 4 else r["n_encoded"] <= 3 * token_counts.LEAF
    odd_state = spark.createDataFrame([(1, "some text here", None, None), (2, "some text here", [3], [1]), (3, None, [], [])], "doc_id long, text string, leaf_chars array<long>, leaf_tokens array<long>")
    got = {r["doc_id"]: (r["text"], r["n_tokens_edited"]) for r in token_counts.update_tokens(odd_state, *RANKS, edits=token_counts.sample_edits(F.col("text"))).collect()}
    assert got[1] == got[2] and got[3][0] == "\n\nRevised text.2026 revised" and all(n == len(it.encode(t)) // 4 for t, n in got.values())


# toxicity


def test_toxicity(spark):
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    toxic, clean = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    better = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.9
    assert sum(s >= 0.7 for s in clean) == 0


def test_labels_of_held_out_rows_count_for_nothing(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.learned_from(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (sorted(toxicity.toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert one == two


def plain_ftrl(rows, size, epochs=6, alpha=2.0, beta=1.0, l1=5.0, l2=0.1):
    """FTRL-proximal, coordinate by coordinate."""
    import math

    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, label in rows:
            at = [*sorted(set(at)), size]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w))))) - label
            for i, x in zip(at, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
                n[i] += g * g
    return {i: w for i in range(size + 1) if (w := weight(i))}


def test_plain_ftrl(spark):
    import random

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["bad", "vile"] if k % 3 == 0 and rng.random() < 0.4 else ["a", "b", "c", "d"]) for _ in range(12)), int(k % 3 == 0)) for k in range(90)]
    at, w = toxicity.fit_ftrl(spark.createDataFrame(rows, "key long, text string, label int"), bits=10)
    order = [r["key"] for r in spark.createDataFrame(rows, "key long, text string, label int").orderBy(toxicity._order("key"), "key").collect()]
    by_key = {k: (t, y) for k, t, y in rows}
    want = plain_ftrl([(toxicity.features(by_key[k][0], 10).tolist(), by_key[k][1]) for k in order], 2**10)
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want) and len(want) > 3


def test_labels_without_documents_take_no_room(spark):
    docs = spark.createDataFrame([(i, "bad vile words here" if i % 2 else "good kind words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(1000, 4000)], "doc_id long, toxic int")
    one = toxicity.fit_toxicity(docs, labels, max_rows=40)
    two = toxicity.fit_toxicity(docs, labels.filter("doc_id < 40"), max_rows=40)
    assert all((x == y).all() for x, y in zip(one, two)) and len(one[0])


def test_bytes_that_are_learned_from_are_bounded(spark):
    rows = [(i, "bad " * 50 if i % 2 else "good " * 50, i % 2) for i in range(40)] + [(99, "x" * 5000, 1)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    chosen = toxicity.sampled(docs, labels, max_rows=100, max_bytes=4800)
    sizes = [len(r["text"]) for r in chosen.collect()]
    assert 3000 < sum(sizes) <= 4800 and 5000 not in sizes


# quality


def plain_quality(text):
    words = WORDS.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n)


def plain_verdict(text):
    """Fraction that repeats cover, and the longest one, by counting all windows of marks."""
    marks = re.findall(r"\w+|[^\w\s]", text)
    longest, inside = 0, set()
    for k in range(1, len(marks)):
        windows = Counter(tuple(marks[i : i + k]) for i in range(len(marks) - k + 1))
        again = [i for i in range(len(marks) - k + 1) if windows[tuple(marks[i : i + k])] > 1]
        if not again:
            break
        longest = k
        if k == quality.MIN_MARKS:
            inside = {j for i in again for j in range(i, i + k)}
    chars = sum(map(len, marks))
    return (sum(len(marks[j]) for j in inside) / chars if chars else 0.0), longest


LOOPS = ["a - b - c - d - e - f - g - h - i - j", "x1*** y2*** z3*** u4*** v5*** w6*** t7*** s8*** r9*** q0***", "one two three four, five six seven eight nine ten eleven twelve. one two three", "é é é é é é é é é é é é", "", "word", ". . . ."]


def test_quality(spark, texts):
    for r in queries.op3_quality(spark, SF).collect():
        assert tuple(r)[1:7] == plain_quality(texts[r["doc_id"]])
        fraction, longest = plain_verdict(texts[r["doc_id"]])
        assert r["repeat_fraction"] == pytest.approx(fraction) and r["longest_repeat"] == longest
        assert r["kept"] == (not r["base_failed"] and fraction <= 0.3 and longest <= 50)
    for text, r in zip(LOOPS, quality.measure(LOOPS)):
        assert r[:6] == plain_quality(text) and r[7:9] == pytest.approx(plain_verdict(text))


def test_quality_leaves_nothing_to_the_garbage_collector():
    """What a batch made goes when it is done, or a worker grows with the rows it has seen."""
    gc.collect()
    gc.disable()
    try:
        quality.measure(LOOPS)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_quality_decides_what_the_base_rule_leaves(spark):
    got = queries.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left")
    alone = got.filter("NOT kept AND NOT base_failed")
    assert alone.count() >= 20 and alone.filter("quality = 1").count() == 0
    long = [" ".join(f"w{i}" for i in range(2000)) + " " + " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(2060))]
    assert [r[5:7] for r in quality.measure(long)] == [(False, False), (False, True)]


def test_spans_of_repeats():
    text = "éa bc, d - xx yy éa bc, d! zz"
    assert [text[x["start"] : x["end"]] for x in quality.measure([text])[0][9]] == ["éa bc, d", "éa bc, d"]


@pytest.mark.parametrize("words, longest, part", [("a b c d e f a b c d e g h i j k", 5, 10), ("a a a a a a", 5, 6), ("a b c", 0, 0)])
def test_repeats(words, longest, part):
    got = quality.measure(["x y z", words])[1]
    assert (got[8], got[4]) == (longest, part)


# near duplicates


def plain_near(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t in texts.items():
        w = WORDS.findall(t.translate(lower))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    least = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {k: (len(sets[k]), least[k], least[k] == k) for k in sets}


def test_near_duplicates(spark, texts):
    want = plain_near(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op4_near_dedup(spark, SF).collect()} == want


def test_near_duplicates_of_a_hot_group(spark, monkeypatch):
    import random

    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for k in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        texts[k] = " ".join(words)
    for block, shingles in ((512, 1_000_000), (4, 500)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(rows).collect()} == plain_near(texts)


def test_near_duplicates_of_odd_rows(odd):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect()}
    assert got[1, 2] == (1, True) and got[2, 0] == (2, True) and got[None, 5] == (None, True) and got[9, 3] == (9, True) and got[10, 3] == (9, False)


def test_blocks_of_a_large_group_with_an_outlier(spark):
    """What is shuffled for 20,000 members of one component and one of another stays in proportion."""
    members = spark.range(20_001).select("id", F.lit(1).alias("key"), F.when(F.col("id") == 777, 1).otherwise(0).cast("long").alias("label"))
    made = near_dedup._in_blocks(members.join(near_dedup._divided(members, "key", F.lit(1), near_dedup.BLOCK), "key"), "key", "id", "label")
    sizes = [len(r["members"]) for r in made.collect()]
    assert sum(sizes) <= 20_001 + 41 and max(sizes) < 2 * near_dedup.BLOCK


@pytest.mark.parametrize("labels", [[0] * 40 + [1], [0] * 9 + [1] * 9 + [2] * 9 + [3], list(range(23)), [5, 5]])
def test_blocks_hold_all_pairs_of_labels(spark, labels):
    members = spark.createDataFrame([(i, 7, x) for i, x in enumerate(labels)], "id long, key int, label long")
    made = near_dedup._in_blocks(members.join(near_dedup._divided(members, "key", F.lit(1), 4), "key"), "key", "id", "label").collect()
    met = {frozenset((x["id"], y["id"])) for r in made for x in r["members"] for y in r["members"] if x["__out"] and x["label"] != y["label"]}
    assert met == {frozenset((i, j)) for i, x in enumerate(labels) for j, y in enumerate(labels) if x != y}


def test_a_candidate_of_many(spark, monkeypatch):
    """Copies in a hot group are dealt out by parts, and all are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join(base[:40] + [f"x{i}"] + base[41:]) for i in range(50)} | {100 + i: f"other text number {i} with words" for i in range(5)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(rows).collect()} == plain_near(texts)


# personal data


def plain_spans(text, mentions=None):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(m):
        total = 0
        for i, c in enumerate(reversed(digits(m))):
            total += (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c)
        return total % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    if mentions is not None:
        for k, (_, p, ok) in enumerate(kinds):
            matches = list(re.finditer(p, text))
            ends = [m.start() for m in matches[2:]] + [len(text)] * 2
            mentions += [(k, m.group().lower(), text[: m.start()], text[m.end() : e]) for m, e in zip(matches, ends) if ok(m.group())]
    counts = Counter(s[3] for s in found)
    said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    return (*(counts[k[0]] for k in kinds), hashlib.sha256(said.encode()).hexdigest())


HARD = [
    "a@b.c_d@e.f é x@y.z", "x@y@z.com a@b. a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 9999999999.1.1.1", "4111 1111 1111 1111-4111-1111-1111-1111", "4111111111111111 5500-0000-0000-0004 1 2",
    "+1 (936) 555-7063 +1234567890123456 ++49 30 1234567", "😀 mail me: q.w+e%r-t@sub.host-1.example.org, or 10.1.2.3!", "1" * 400, "a" * 3000 + "@b", "." * 50 + "@x.y",
]


def test_patterns(spark, texts):
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:6] for r in pii.personal_data(rows).collect()} == {i: plain_spans(t) for i, t in enumerate(HARD)}
    assert {r["doc_id"]: tuple(r)[1:6] for r in queries.op5_pii(spark, SF).collect()} == {k: plain_spans(t) for k, t in texts.items()}


def plain_terms(texts, support=3, least=0.8):
    """Terms and the most that they disclose, from all pairs of terms and entities."""
    import math

    word = re.compile(r"[^\W_]+")
    terms = lambda t: {w for w in word.findall(t.lower()) if len(w) >= 3}
    df, df_entity, joint, evidence = Counter(), {}, {}, {}
    for doc, text in texts.items():
        df.update(terms(text))
        plain_spans(text, mentions := [])
        for kind, value, before, after in mentions:
            if len(before) > 80:
                before = re.sub(r"^[^\W_]*", "", before[-81:])
            if len(after) > 80:
                after = re.sub(r"[^\W_]*$", "", after[:81])
            digits = re.sub("[^0-9]", "", value)
            shared = [value.split("@")[-1], ".".join(value.split(".")[:2]), digits[:6], digits[:4]][kind]
            for entity, proof in (("value", kind, value), (before, after)), (("shared", kind, shared), value), (("kind", kind), value):
                df_entity.setdefault(entity, set()).add(doc)
                for t in terms(f"{before} {after} {value}"):
                    joint.setdefault((entity, t), set()).add(doc)
                    evidence.setdefault((entity, t), set()).add(proof)
    told, n = {}, len(texts)
    for (entity, t), docs in joint.items():
        e = len(df_entity[entity])
        if len(evidence[entity, t]) >= support and e < n:
            told[t] = max(told.get(t, -9), math.log(n * len(docs) / (df[t] * e)) / math.log(n / e))
    return {t: d for t, d in told.items() if d >= least}


def test_terms_by_brute_force(spark, texts):
    import random

    rng = random.Random(8)
    names = [f"name{i}" for i in range(12)]
    made = {}
    for i in range(300):
        words = [f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            k = rng.randrange(12)
            value = [f"u{rng.randrange(6)}@host{k % 4}.example", f"10.{k}.{rng.randrange(3)}.7", f"+1 ({200 + k % 3}) 555-{1000 + rng.randrange(20)}"][k % 3]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [names[k], value] if rng.random() < 0.9 else [value]
        made[1000 + i] = " ".join(words)
    made[1] = "é" * 100 + "abcdef a@b.c x@y.z 1.2.3.4 " + "ghijkl" * 30
    for data in (made, texts):
        rows = pii.keyed(spark.createDataFrame(list(data.items()), "doc_id long, text string"))
        got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(rows, pii.pattern_spans(rows)).collect()}
        assert got == pytest.approx(plain_terms(data)) and (got or data is texts)


def test_terms_of_planted_names(spark):
    """Names planted beside addresses in a copy of the real table, and alone in other documents: all of them are found, and nothing that reveals nobody.

    The given prose has no names beside its values, so without planting terms are few: at sf0.1 in two documents, what is left of phone
    numbers that run into an address.
    """
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    names, common = [f"Qarvilon{c}" for c in "abcdefgh"], "Bystander"
    planted, alone = {}, {}
    for k, name in enumerate(names):
        for j in range(6):  # beside the address, with a word that is in a tenth of all documents
            planted[20 * j + 2 * k] = f" {common} {name} writes from u{k}@host{k}.example "
        for j in range(3):
            alone[500 + 20 * j + 2 * k] = f" so said {name} today "
    made = []
    for i, (doc, text) in enumerate(docs):
        more = planted.get(i, alone.get(i, f" {common} " if i % 10 == 1 else ""))
        at = text.find(" ") + 1 if i % 2 else len(text)
        made.append((doc, text[:at] + more + text[at:]))
    told = spark.createDataFrame(made, "doc_id long, text string")
    rows = pii.keyed(told)
    found = {r["term"] for r in pii.disclosing_terms(rows, pii.pattern_spans(rows)).collect()}
    plain = pii.keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    before = {r["term"] for r in pii.disclosing_terms(plain, pii.pattern_spans(plain)).collect()}
    true = {n.lower() for n in names} | {f"{part}{k}" for k in range(len(names)) for part in ("u", "host")}
    new = found - before
    assert {n.lower() for n in names} <= new  # recall of names
    assert len(new & true) / len(new) >= 0.9 and common.lower() not in found  # precision
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(told).collect()}
    assert not any(n in t for n in names for t in clean.values())
    spans = {r["doc_id"]: r["n_term"] for r in pii.personal_data(told).collect()}
    assert all(spans[docs[i][0]] >= 1 for i in alone)


def test_shared_parts_are_protected(spark):
    """Ten people of one firm, each named once with an address and a title: the title reveals the firm, the copies prove nothing."""
    rows = [(i, f"note{i} about our Chiefwidgeteer person{i} p{i}@firm.example only{i}") for i in range(10)]
    rows += [(100 + i, "Copiedword copied@other.example ends") for i in range(10)]
    rows += [(1000 + i, f"note{i} about our person only other{i} words{i}") for i in range(300)]
    rows.append((5000, "the Chiefwidgeteer and a Copiedword"))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[5000] == "the  and a Copiedword" and clean[0] == "note0 about our  person0 <EMAIL> only0" and clean[1000] == dict(rows)[1000]


def test_disclosing_terms(spark):
    filler = "many other words that everyone writes in letters number"
    rows = [(i, f"{filler} {i} please write to Zorblax at the house zed@mail.example about thing{i}") for i in range(6)]
    rows += [(100 + i, f"{filler} {i} please write to someone at the house about thing{i}") for i in range(60)]
    rows.append((200, "here Zorblax is named alone"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[0]["n_term"] == 1 and got[100]["n_term"] == 0 and got[200]["n_term"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zorblax" not in clean[0] and "<EMAIL>" in clean[0] and "someone" in clean[100] and "Zorblax" not in clean[200] and clean[100] == dict(rows)[100]


def test_disclosure_thresholds(spark):
    """Of 1,000 documents three name the address: a term in six discloses 0.88 of it, one in four 0.9505, one in ten 0.79."""
    named = ["Zorblax Quimby Vandrell"] * 3 + ["Zorblax Quimby"] + ["Quimby"] * 2
    rows = [(i, f"start{i} {'zed@mail.example ' if i < 3 else ''}{words} end{i}") for i, words in enumerate(named)]
    rows += [(10 + i, f"start{10 + i} Ostrander") for i in range(7)]
    rows = [(i, f"{text} Ostrander" if i < 3 else text) for i, text in rows]
    rows += [(100 + i, f"filler{i}") for i in range(1000 - len(rows))]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "start0 <EMAIL>  <TERM>  end0 Ostrander" and clean[3] == "start3  <TERM> end3" and clean[5] == "start5 <TERM> end5" and clean[10] == "start10 Ostrander"


def test_sanitised_text(spark, odd):
    rows = spark.createDataFrame([(1, "a 1.2.3.4 b x@y.z", 17), (2, None, None), (3, "none", 4)], "doc_id long, text string, n_chars int")
    assert {tuple(r) for r in pii.sanitise(rows).collect()} == {(1, "a <IP> b <EMAIL>", 16), (2, None, None), (3, "none", 4)}


# encoding


def test_bpe(spark, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS[0].splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=RANKS[1], mergeable_ranks=ranks, special_tokens={})
    for r in queries.op8_bpe(spark, SF).collect():
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_round_trip(odd):
    for r in bpe.bpe_encode(odd.select("doc_id", "text"), *RANKS, keys=("doc_id", "text")).collect():
        assert r["decoded"] == (r["text"] or "") and len(r["token_ids"]) == r["n_tokens"]


# repeated strings


def plain_repeats(texts, length):
    data = {k: t.encode() for k, t in texts}
    often = Counter(d[i : i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[k] = (len(d), len(d) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


@pytest.mark.parametrize("group, batches", [(1000, 4), (2, 1), (1, 7)])
def test_repeated_strings(spark, monkeypatch, group, batches):
    import random

    rng = random.Random(9)
    monkeypatch.setattr(substrings, "GROUP", group)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    common, texts = word(180), []
    for k in range(60):
        t = word(rng.choice([10, 150, 400]))
        if k % 2:
            t += common[rng.randrange(80) :][: rng.randint(60, 180)] + word(90)
        if k % 9 == 0:
            t += "z" * 150 + "xy" * 100
        texts.append((k, t))
    texts += [(100, texts[0][1]), (101, ""), (102, texts[9][1] + "!")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (*tuple(r)[1:4], bytes(r["kept"])) for r in substrings.remove_repeats(rows, length=100, batches=batches).collect()}
    assert got == plain_repeats(texts, 100)


def test_query_at_its_own_length(spark):
    """All rows of a table against every window of 400 bytes."""
    sf = "/root/testdata/sf0.01"
    data = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    once, often = set(), set()
    for d in data.values():
        for i in range(len(d) - 399):
            h = hash(d[i : i + 400])
            (often if h in once else once).add(h)
    lost = 0
    for r in queries.op9_substrings(spark, sf).collect():
        d = data[r["doc_id"]]
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if hash(d[i : i + 400]) in often:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest())
        lost += len(kept) < len(d)
    assert lost > 100


def test_repeats_of_equal_rows(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    rows = spark.createDataFrame([(1, text), (1, text), (2, "short"), (None, None)], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in substrings.remove_repeats(rows).collect()) == [(0, 0), (5, 0), (500, 500), (500, 500)]


# mixing


def plain_targets(sizes, share=1.5, most=2):
    """Targets by sharing the excess of full sources again and again."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: most * sizes[s] for s in full}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_mixing(spark, sf):
    rows = queries.op10_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    target, largest = plain_targets(sizes), max(r["size"] for r in rows)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_rows_with_one_id_are_spread(spark, monkeypatch):
    """A third of all rows has no id: their places in the queue are dealt out, and the mix is still right."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(None if i % 3 == 0 else i, f"s{i % 2}", 10 + i % 7) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    queued = mixing.queue(sized, 1.5, 2, 7)
    assert queued.filter("doc_id IS NULL").select("__key").distinct().count() == 10
    got = mixing.mix_counts(sized).collect()
    total, taken, target = Counter(), Counter(), {}
    for r in got:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(got) == 3000 and all(abs(taken[s] - target[s]) <= 40 for s in total)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_counts(sized).collect()), key=str)


def test_places_in_a_queue(spark, monkeypatch):
    """Running sums over groups of buckets are those over the whole source."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    sized = spark.createDataFrame([(i, f"s{i % 2}", 1 + i * i % 11) for i in range(700)], "doc_id long, source string, size long")
    for source in ("s0", "s1"):
        rows = sorted(mixing.queue(sized, 1.5, 2, 7).filter(F.col("source") == source).collect(), key=lambda r: (r["__key"], r["doc_id"]))
        ends = [sum(r["size"] for r in rows[: i + 1]) for i in range(len(rows))]
        assert [r["__end"] for r in rows] == ends


def test_mixed_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["taken"] // r["size"] for r in queries.op10_mixing(spark, SF).filter("taken > 0").collect()}
    assert Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect()) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_mix_does_not_depend_on_splits(spark, monkeypatch):
    """Many rows with one id, equal ones and others, over several splits of the table."""
    from roundweave.llm import mixing as m

    monkeypatch.setattr(m, "BUCKET_ROWS", 20)
    rows = [(None, "same words here", "a")] * 150 + [(None, f"other words {i % 7} and {i % 3}", "a") for i in range(100)] + [(5, "x y z", "b")] * 60 + [(i, "w " * (i % 9), "b" if i % 2 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for parts in (1, 3, 8):
        mixed = Counter(map(tuple, m.mix(docs.repartition(parts)).collect()))
        counts = m.mix_counts(docs.repartition(parts).select("doc_id", "source", m.word_count(docs["text"]).alias("size")))
        seen.append((mixed, Counter(map(tuple, counts.collect()))))
    assert seen[0] == seen[1] == seen[2] and sum(seen[0][0].values()) > 300
