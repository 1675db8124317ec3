"""The Merkle manifest against a plain one, over parts that cut runs in all ways."""

import zlib
from hashlib import sha256

import pytest

from roundweave.llm import manifest, queries
from tests.conftest import SF, same_rows


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i, now, proof):
    for nodes in levels[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(nodes)))
        proof += [nodes[n] for n in run if n != i]
        now, i = h(*(now if n == i else nodes[n] for n in run)), i // 3
    return now


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            proof = []
            folded = climb(trees[s], i, leaf(r, r["text"].replace("\n", "") if hit else r["text"]), proof)
            folded = climb(top, k, folded, proof)
            yield r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]


def same(docs):
    got = manifest.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, want = sorted(map(tuple, got.collect()), key=str), sorted(plain(docs.collect()), key=str)
    assert got == want
    return got


def test_sql(spark, duck):
    same_rows(queries.op13_manifest(spark, SF).toPandas(), duck.sql(queries.ORACLES["op13_manifest"]).df())


@pytest.mark.parametrize("rows, fan", [(7, 2), (1, 3), (40, 32)])
def test_parts(docs, monkeypatch, rows, fan):
    """Small parts and many rounds of merging make the same trees, and tampered rows alone fail."""
    monkeypatch.setattr(manifest, "PART_ROWS", rows)
    monkeypatch.setattr(manifest, "FAN", fan)
    got = same(docs.limit(60) if rows == 1 else docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, *_, verified in got:
        assert verified == (zlib.crc32(str(doc_id).encode()) % 2 == 1 or "\n" not in (texts[doc_id] or ""))


def test_odd_rows(odd, none, monkeypatch):
    same(odd)
    assert manifest.manifest(none).collect() == []
    monkeypatch.setattr(manifest, "PART_ROWS", 2)
    same(odd)


def test_many_equal_rows(spark, monkeypatch):
    """Rows that nothing tells apart are dealt out to many parts, and one row alone is the root."""
    monkeypatch.setattr(manifest, "PART_ROWS", 5)
    rows = [(None, "same\ntext", None, "s", 3)] * 50 + [(n, "a\nb", "en", None, 3) for n in range(9)] + [(1, "é日\n", "en", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    same(docs)
    trees = manifest.Trees(docs.selectExpr("source AS g", "doc_id AS k", "sha2(coalesce(text, ''), 256) AS leaf"), "t")
    assert trees.leaves.groupBy("part").count().agg({"count": "max"}).first()[0] < 30
    one = docs.filter("source = 't'")
    ((_, made, subroot, root, proof, folded, verified),) = same(one)
    assert made == subroot == root and proof == h() and verified == (folded == root)


def test_forests_are_a_monoid():
    """Any order of merging, and any grouping, leaves one root, and never more than four open nodes a level."""
    import random

    leaves = [h(str(i)) for i in range(200)]
    want = tree(leaves)[-1][0]
    for seed in range(5):
        rng = random.Random(seed)
        cuts = sorted(rng.sample(range(1, 200), 12))
        forests = []
        for a, b in zip([0, *cuts], [*cuts, 200]):
            f = manifest.Forest(200)
            f.nodes[0] = {i: leaves[i] for i in range(a, b)}
            forests.append(list(f.left(f.resolve())))
            per_level = [sum(level == n for level, *_ in forests[-1]) for n in range(6)]
            assert max(per_level) <= 4
        while len(forests) > 1:
            one, two = (forests.pop(rng.randrange(len(forests))) for _ in range(2))
            f = manifest.Forest(200)
            for level, i, value, _ in one + two:
                f.nodes[level][i] = value
            forests.append(list(f.left(f.resolve())))
        assert forests == [[(5, 0, want, manifest.SUBROOT)]]
