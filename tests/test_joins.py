"""Numbering, drawing and splitting of rows, images found again by hashes, and values that must be met exactly."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from roundweave import sources
from roundweave.functions import text as T
from roundweave.operators import convert, edit, graph, select, stats

TYPE = "array<struct<role:string,content:string>>"


@pytest.mark.parametrize("by", [None, "g"])
def test_numbered(spark, by):
    rng = random.Random(6)
    keys = rng.sample(range(10_000), 200) + [None]
    rows = spark.createDataFrame([(k, "x" if i % 3 else None) for i, k in enumerate(keys)], "k long, g string").repartition(5)
    got = select.numbered(rows, "k", "at", by=by, part_rows=7).collect()
    for g in {r["g"] for r in got} if by else [0]:
        mine = sorted((r for r in got if not by or r["g"] == g), key=lambda r: (r["k"] is not None, r["k"] or 0))
        assert [r["at"] for r in mine] == list(range(len(mine)))
    assert select.numbered(rows.limit(0), "k", "at").count() == 0


def test_drawn(spark):
    named = {n: select.numbered(spark.range(k).withColumnRenamed("id", "v"), "v", "p") for n, k in (("a", 40), ("b", 300))}
    got = select.drawn(named, "p", {"a": 40, "b": 300}, [0.25, 0.75], seed=2).orderBy("turn").collect()
    assert [r["turn"] for r in got] == list(range(len(got)))
    for n in "ab":
        assert [r["v"] for r in got if r["_dataset_name"] == n] == list(range(sum(r["_dataset_name"] == n for r in got)))
    assert sum(r["_dataset_name"] == "a" for r in got) == 40 and 80 < len(got) < 260


def test_splits(spark):
    rows = spark.range(500)
    assert select.split_rows(rows, "id", 37).filter("held_out").count() == 37 and select.split_rows(rows, "id", 900).filter("NOT held_out").count() == 0
    assert 30 < select.split_rows(rows, "id", 0.1, seed=3).filter("held_out").count() < 75


def test_zipped(spark):
    one, two = spark.range(5).withColumnRenamed("id", "_idx"), spark.range(5).select(F.col("id").alias("_idx"), (F.col("id") * 2).alias("y"))
    assert sorted(map(tuple, select.zipped(one, two).collect())) == [(i, 2 * i) for i in range(5)]
    with pytest.raises(ValueError):
        select.zipped(one, two.limit(3))


ODD = ['say "hi" \\ there', "line\nnext\r\ttab\b\f", "\x00\x01\x0b\x1f\x7f", "é 日 😀 / </b>", "", None, "\\u000B \\n"]


def test_message_hash_is_that_of_sorted_json(spark):
    messages = [("user", c) for c in ODD] + [(None, "x")]
    rows = spark.createDataFrame([(messages,), ([],)], f"m {TYPE}")
    want = [json.dumps([{"role": r, "content": c} for r, c in m], sort_keys=True, ensure_ascii=False) for m in (messages, [])]
    assert [r[0] for r in rows.select(T.message_json(F.col("m"))).collect()] == want
    assert [r[0] for r in rows.select(T.message_hash(F.col("m"))).collect()] == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_images_are_rejoined(spark):
    full = [("user", "q <image>"), ("assistant", "a"), ("user", "<image><image>"), ("assistant", "b"), ("user", "r <image>"), ("assistant", "end")]
    source = spark.createDataFrame([(full, ["old"], 1), (full, ["i1", "i2", "i3", "i4"], 2), ([("user", "other")], [], 3)], f"messages {TYPE}, images array<string>, ord int")
    without = full[:1] + full[3:]
    rows = [(1, full, without, [2]), (2, full, full, [2]), (3, full[:2], full, []), (4, None, full, []), (5, full, full, []), (6, full[:1] + full[3:5], full, []), (7, [], full, [])]
    joined = edit.images_rejoined(spark.createDataFrame(rows, f"id int, original {TYPE}, messages {TYPE}, removed array<int>"), source)
    got = {r["id"]: (r["state"], r["images"]) for r in joined.collect()}
    assert got == {1: ("ok", ["i1", "i4"]), 2: ("mismatch", ["i1", "i4"]), 3: ("unmatched", None), 4: ("no_original", None), 5: ("ok", ["i1", "i2", "i3", "i4"]), 6: ("unmatched", None), 7: ("no_original", None)}
    with pytest.raises(ValueError, match="1 mismatch, 2 no_original, 2 unmatched"):
        edit.all_rejoined(joined)
    assert edit.all_rejoined(joined.filter("id IN (1, 5)")).count() == 2


def test_rephrased_by_a_cache(spark):
    messages = [("user", "q"), ("assistant", "<think>a</think><tool_call>x</tool_call>"), ("user", "r"), ("assistant", "<think>b</think><tool_call>y</tool_call>"), ("user", "s"), ("assistant", "<think>c</think>")]
    rows = spark.createDataFrame([(1, messages, [[2, 3]]), (2, messages, [])], f"conv_id int, messages {TYPE}, groups array<array<int>>")
    key = hashlib.sha256("a;\nb".encode()).hexdigest()
    told = edit.rephrased_by(rows, spark.createDataFrame([(key, "both"), ("no", "x")], "key string, value string"))
    got = {r["conv_id"]: r["m"] for r in told.select("conv_id", edit.merged(F.col("messages"), F.col("groups"), pairwise=False, rephrased=F.col("rephrased")).alias("m")).collect()}
    assert got[1][1]["content"] == "<think>both</think><tool_call>x\ny</tool_call>" and got[2][1]["content"] == messages[1][1]


def test_results_per_call(spark):
    out = '<think>t</think><tool_call>{"name":"a"}</tool_call><tool_call>{"name":"b"}</tool_call><tool_call>{"x":1}</tool_call>'
    made = spark.range(1).select(convert.traced_turn(F.lit(out), F.array(F.lit("one"), F.lit("two"))).alias("t")).first()["t"]
    assert made["user"] == "<tool_response>From: a\noneFrom: b\ntwoFrom: tool_call\n</tool_response>"


def test_common_subsequences():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randrange(40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert stats.common_length(a, b) == row[-1]
    assert stats.common_length(["w"] * 20_000, ["w", "x"] * 10_000) == 10_000


def test_packing_values(spark):
    masks = [[1, 1, 2, 2, 2, 0], [1, 2, 2, 3, 3, 3], [1]]
    rows = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    got = rows.select(stats.sequence_lengths(F.col("m")).alias("l"), stats.unpadded(F.col("m")).alias("u")).select("l", "u", stats.running_offsets(F.col("l")).alias("o"), F.array_max("l").alias("x")).collect()
    assert [r["l"] for r in got] == [[2, 3], [1, 2, 3], [1]] and [r["x"] for r in got] == [3, 3, 1]
    batch, width = got[:2], 6
    assert [i * width + k for i, r in enumerate(batch) for k in r["u"]] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    upto = [0]
    for n in (n for r in batch for n in r["l"]):
        upto.append(upto[-1] + n)
    assert upto == [0, 2, 5, 6, 8, 11] and (got[2]["u"], got[2]["o"]) == ([0], [0, 1])


@pytest.mark.parametrize(
    "lang, words, subject, head, call",
    [
        ("en", ("Fewshot question", "Target question"), "SubName", "The following are multiple choice questions (with answers) about SubName.\n\n", "\nAnswer:"),
        ("zh", ("示例问题", "目标问题"), "主题", "以下是中国关于主题考试的单项选择题，请选出其中的正确答案。\n\n", "\n答案："),
    ],
)
def test_few_shot_values(spark, lang, words, subject, head, call):
    item = lambda q, answer: (q, *(f"{q[0]}{i}" for i in range(1, 5)), answer)
    kind = "struct<question:string,A:string,B:string,C:string,D:string,answer:string>"
    rows = spark.createDataFrame([(item(words[1], "C"), [item(words[0], "B")])], f"t {kind}, s array<{kind}>")
    asked = lambda q: q + "".join(f"\n{c}. {q[0]}{i}" for i, c in enumerate("ABCD", 1)) + call
    got = [tuple(m) for m in rows.select(convert.few_shot(F.col("t"), F.col("s"), subject, lang)).first()[0]]
    assert got == [("user", head + asked(words[0])), ("assistant", "B"), ("user", asked(words[1])), ("assistant", "C")]


def test_relaxed_merging_in_any_direction(spark):
    from tests.test_graph import pairs, plain_relaxed

    rng = random.Random(5)
    graphs = []
    for _ in range(60):
        n = rng.randint(2, 8)
        order = rng.sample(range(1, n + 1), n)
        edges = [(order[i], order[j]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        graphs += [edges] if edges else []
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(graphs)], "i int, edges array<struct<src:int,dst:int>>").repartition(3)
    parts = {r[0]: r[1] for r in rows.select("i", F.array_distinct(F.transform(graph.relaxed_groups(F.col("edges")), lambda g: g["members"]))).collect()}
    assert {i: sorted(map(sorted, p)) for i, p in parts.items()} == {i: plain_relaxed(g, rng) for i, g in enumerate(graphs)}
    cyclic = spark.createDataFrame([([("1", "2"), ("2", "3"), ("3", "1")],), (None,)], "e array<struct<src:string,dst:string>>")
    assert sorted((pairs(r["walked"]) for r in graph.without_cycles(cyclic, F.col("e")).collect() if r["walked"]), key=str) == [[("1", "2"), ("2", "3")]]


def test_nothing_is_lost_when_a_folder_is_replaced(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = spark.createDataFrame([(1,), (2,)], "_idx int")
    sources.replace_if_clean(rows, rows.limit(0), path)
    sources.replace_if_clean(spark.read.json(path).filter("_idx = 1"), rows.limit(0), path)
    assert [r[0] for r in spark.read.json(path).collect()] == [1] and sorted(p.name for p in tmp_path.iterdir()) == ["data"]
    (tmp_path / "data").rename(tmp_path / "data.old")  # as a crash between the two moves leaves it
    with pytest.raises(ValueError):
        sources.replace_if_clean(rows, rows, path)
    sources.replace_if_clean(rows, rows.limit(0), path)
    assert spark.read.json(path).count() == 2 and not (tmp_path / "data.old").exists()
    edited = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, 2), (4, None, None)], "_idx int, pruned int, merged int")
    sources.write_changed(edited, str(tmp_path / "changed"))
    assert sorted(r["_idx"] for r in spark.read.json(str(tmp_path / "changed")).collect()) == [2, 3]
