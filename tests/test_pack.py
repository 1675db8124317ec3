"""Packing against plain best-fit-decreasing, and masks that are read back."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from roundweave.operators import pack, stats
from roundweave.plans import ORACLES, QUERIES
from tests.conftest import same_rows


def fitted(lengths, cutoff, best):
    """Fills of blocks by best-fit-decreasing, or first-fit-decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i]) if best else fit[0]] -= n
        else:
            rooms.append(cutoff - n)
    return sorted(cutoff - room for room in rooms)


def lengths_of(rng, cutoff):
    return [rng.randint(1, cutoff) if rng.random() < 0.5 else rng.randint(1, max(1, cutoff // 6)) for _ in range(rng.randint(0, 250))]


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rng = random.Random(seed)
    cutoff = rng.choice([1, 5, 10, 37, 100])
    lengths = lengths_of(rng, cutoff)
    pieces, blocks = pack.plan(Counter(lengths), cutoff)
    inside, dealt = {}, []
    for length, first, n, each, block, offset, before in pieces:
        for i in range(n):
            inside.setdefault(block + i // each, []).append((offset + i % each * length, length, before + i % each + 1))
            dealt.append((length, first + i))
    assert sorted(dealt) == sorted((n, i) for n, k in Counter(lengths).items() for i in range(k))
    for samples in inside.values():
        at = 0
        for no, sample in enumerate(sorted(samples), 1):
            assert (sample[0], sample[2]) == (at, no)
            at += sample[1]
    fills = sorted(sum(n for _, n, _ in s) for s in inside.values())
    assert set(inside) == set(range(blocks)) and fills == fitted(lengths, cutoff, best=True)
    assert blocks <= 11 / 9 * -(-sum(lengths) // cutoff) + 4 + sum(n > cutoff / 2 for n in lengths)
    assert blocks <= len(fitted(lengths, cutoff, best=False)) + 2


def test_plan_does_not_grow_with_rows():
    """A thousand times the rows make hardly more pieces."""
    few, many = (pack.plan({n: times * (1 + n % 7) for n in range(1, 1001)}, 1000)[0] for times in (10, 10_000))
    assert len(many) < 2 * len(few)
    with pytest.raises(ValueError):
        pack.plan({11: 1}, 10)


@pytest.mark.parametrize("part_rows", [7, 10**6])
def test_packed(spark, part_rows):
    """One length with a third of the rows, keys that repeat, and lengths that take no part."""
    rng = random.Random(3)
    rows = [(i, 64 if i % 3 == 0 else rng.randint(1, 90)) for i in range(600)] + [(None, 3), (7, 5), (7, 5), (-1, None), (-2, 0), (-3, -4)]
    table = spark.createDataFrame(rows, "id long, n int").repartition(6)
    got = pack.packed(table, "id", F.col("n"), 64, part_rows)
    made = got.collect()
    assert Counter((r["id"], r["length"]) for r in made) == Counter((i, None if n is None or n < 1 else min(n, 64)) for i, n in rows)
    assert all((r["block"] is None) == (r["id"] is not None and r["id"] < 0) for r in made)
    by = {}
    for r in made:
        if r["block"] is not None:
            by.setdefault(r["block"], []).append((r["offset"], r["length"], r["no"]))
    for samples in by.values():
        at = 0
        for no, (offset, length, own) in enumerate(sorted(samples), 1):
            assert (offset, own) == (at, no)
            at += length
    assert sorted(sum(s[1] for s in x) for x in by.values()) == fitted([min(n, 64) for _, n in rows if n and n > 0], 64, best=True)
    assert sorted(map(str, pack.packed(table.repartition(2), "id", F.col("n"), 64, part_rows).collect())) == sorted(map(str, made))
    masks = {r["block"]: list(r["mask"]) for r in pack.masks(got, 64).collect()}
    want = {b: sum(([no] * n for _, n, no in sorted(x)), []) for b, x in by.items()}
    assert masks == {b: m + [0] * (64 - len(m)) for b, m in want.items()}
    assert all(set(r["mask"]) <= {0, 1} for r in pack.masks(got, 64, neat=False).collect())


def test_ids(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, [5, 6, 7, 8, 9]), (4, [])], "id long, ids array<int>")
    blocks = pack.joined(rows, pack.packed(rows, "id", F.size("ids"), 4), "id", "ids", 4)
    assert sorted(r["ids"] for r in blocks.collect()) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    none = rows.limit(0)
    assert pack.packed(none, "id", F.size("ids"), 4).collect() == [] and pack.masks(pack.packed(none, "id", F.size("ids"), 4), 4).collect() == []
    assert [r["block"] for r in pack.packed(rows.filter("id = 4"), "id", F.size("ids"), 4).collect()] == [None]


def test_offsets(spark):
    """Of masks with gaps, padding anywhere, and a hundred thousand places."""
    long = [i // 3 + 1 for i in range(100_000)] + [0] * 50
    masks = [[1, 1, 2, 2, 2, 0], [1, 2, 2, 3, 3, 3], [0, 3, 1, 0, 1], [0, 0], [], None, long]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, m array<int>").select("i", stats.sequence_lengths(F.col("m")).alias("n"), stats.sequence_offsets(F.col("m")).alias("o")).orderBy("i").collect()
    assert [r["n"] for r in got[:5]] == [[2, 3], [1, 2, 3], [2, 1], [], []]
    assert [r["o"] for r in got[:5]] == [[0, 2, 5], [0, 1, 3, 6], [0, 2, 3], [0], [0]]
    assert got[6]["n"] == [3] * 33333 + [1] and got[6]["o"][-2:] == [99_999, 100_000]


def test_products_are_floats(spark, tmp_path):
    """Components whose product is whole as a float and just below as a double."""
    vectors = np.abs(np.random.default_rng(5).normal(0, 0.125, (40, 64))).astype(np.float32)
    vectors[:10] = [[(7 * i + k) % 99 / 40 for k in range(64)] for i in range(10)]
    vectors[10:20] = [[(7 * i + k) % 99 / 10 for k in range(64)] for i in range(10)]
    pq.write_table(pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    for name in ("packing_lengths", "unpadded_places", "token_accuracy"):
        same_rows(QUERIES[name](spark, str(tmp_path)).toPandas(), db.sql(ORACLES[name]).df())
