"""The permutation index against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundweave.llm import permutations, queries
from tests.conftest import SF


def brute(rows, queries, k=10):
    """The k nearest others of each query, by distance and id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = {}
    for q in queries:
        own = x[np.flatnonzero(ids == q)[0]]
        apart = np.sqrt(((x - own) ** 2).sum(axis=1))
        apart[ids == q] = math.inf
        found[q] = [(int(ids[i]), float(apart[i])) for i in np.lexsort((ids, apart))[:k] if apart[i] < math.inf]
    return found


def recall(got, rows, want):
    """Share of the true neighbours found. Ranks and scores have to be right for what was found."""
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(want)
    for q, mine in by.items():
        assert [r["rank"] for r in mine] == list(range(1, len(want[q]) + 1))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(r["vec_id"] != q and r["score"] == np.sqrt(((vectors[r["vec_id"]] - vectors[q]) ** 2).sum()) for r in mine)
    return sum(len({r["vec_id"] for r in by[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def given(spark, folder):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_query(spark, folder):
    rows = given(spark, folder)
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert recall(queries.op12_neighbours(spark, folder).collect(), rows, want) >= 0.95


def test_many_shards(spark):
    """Little is reranked in each of many shards, and blocks of queries don't change what is found."""
    rows = given(spark, "/root/testdata/sf0.1")
    index = permutations.PermutationIndex(spark.createDataFrame(rows, "id long, v array<float>").repartition(3), shard_rows=150)
    assert index.table.count() == 14
    chosen = spark.createDataFrame([r for r in rows if r[0] % 10 == 0], "id long, v array<float>")
    want = brute(rows, [i for i, _ in rows if i % 10 == 0])
    few = index.search(chosen, 10, share=0.25, least=10)
    assert 0.9 <= recall(few.collect(), rows, want)
    assert sorted(few.collect()) == sorted(index.search(chosen, 10, share=0.25, least=10, block_queries=17).collect())
    assert recall(index.search(chosen, 10, share=1.0).collect(), rows, want) == 1.0


def test_footrule():
    """Sums over inverted files choose the rows whose footrule distance is smallest, ties included."""
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(9, 4))
    orders, asked = permutations.places(rng.normal(size=(60, 4)), pivots), permutations.places(rng.normal(size=(5, 4)), pivots)
    row, pivot = np.nonzero(orders < 5)
    order = np.lexsort((row, orders[row, pivot], pivot))
    chosen = permutations._like(np.cumsum(np.bincount(pivot, minlength=9)), row[order].astype(np.int32), orders[row, pivot][order], asked, 60, 12)
    for q, mine in enumerate(asked):
        footrule = np.abs(orders.astype(int) - mine).sum(axis=1)
        assert (chosen[:, q] == (footrule <= np.sort(footrule)[11])).all()


def test_copies(spark):
    """A vector that most rows have is found whole, its copies in the order of their ids."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.5, 0.25, 0.125] if i % 3 else list(map(float, rng.normal(size=3)))) for i in range(900)]
    index = permutations.PermutationIndex(spark.createDataFrame(rows, "id long, v array<double>"), shard_rows=100)
    asked = [i for i in range(0, 900, 50)]
    got = index.search(spark.createDataFrame([rows[i] for i in asked], "id long, v array<double>"), 10, least=20).collect()
    want = brute(rows, asked)
    for q in asked:
        if q % 3:
            assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want[q]
    same = permutations.nearest(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=3)
    assert sorted(map(tuple, same.collect())) == [(q, n + 1, v, 0.0) for q, found in ((0, (1, 2, 3)), (100, (0, 1, 2)), (200, (0, 1, 2))) for n, v in enumerate(found)]


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [4.0, 4.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, -0.0]), (8, []), (None, [1.0, 1.0]), (100, [1.0, 1.5]), (100, [1.0, 2.5]), (9, [1.0]), (2, [4.0, 4.5])]
    table = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "vec_id long, embedding array<double>, d int, id long, v int")
    got = permutations.nearest(table, F.col("vec_id") % 100 == 0, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (0, 3, 100, 2.0), (0, 4, 2, 5.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, math.sqrt(18)), (100, 4, 2, math.sqrt(18))]
    assert permutations.nearest(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert permutations.nearest(table, F.col("vec_id") == 77).collect() == []
    big = spark.createDataFrame([(i, [1e300 * (i + 1), -1e300]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r["score"] for r in permutations.nearest(big, F.col("vec_id") == 0).collect()] == [inf] * 4


def spread(n, seed):
    """Vectors that are spread evenly over the sphere, as the given ones are."""
    x = np.random.default_rng(seed).normal(size=(n, 64))
    return (x / np.sqrt((x**2).sum(axis=1))[:, None]).astype(np.float32)


def test_time_follows_the_pairs(spark):
    """A pair of a query and a row takes nanoseconds: 400 million pairs took 4 workers minutes, by loops over pivots and queries."""
    import time

    import pyarrow as pa

    x = spread(20_000, 5)
    table = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "v": pa.array(list(x), pa.list_(pa.float32()))})).cache()
    index = permutations.PermutationIndex(table)
    began = time.time()
    found = index.search(table, 10).filter(F.col("query_id") % 400 == 0).toPandas()
    assert time.time() - began < 40
    scores = x.astype(np.float64)
    hit = 0
    for q in range(0, len(x), 400):
        apart = ((scores - scores[q]) ** 2).sum(axis=1)
        hit += len(set(found.vec_id[found.query_id == q]) & set(np.argsort(apart)[1:11].tolist()))
    assert hit >= 0.97 * 500


def test_nothing_is_broadcast(spark):
    """Blocks of queries stand once for each shard in a join, so they must not go through the driver, whatever Spark takes for their size."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    found = permutations.PermutationIndex(rows, shard_rows=50).search(rows.filter("id % 5 = 0"), 3, block_queries=17)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e3, 1e25, 1e300])
def test_rerank(scale):
    """The best of what was chosen are those of brute force, also among copies and near copies, and where 32 bits overflow."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x[100:200] = x[7] + 1e-6 * rng.normal(size=(100, 8))
    x[200:260] = x[8]
    x *= scale
    ids, own = rng.permutation(400), np.array([-1, 5, 9, 9, 11])
    queries = np.concatenate([x[7:10], x[205:206], scale * rng.normal(size=(1, 8))])
    chosen = rng.random((5, 400)) < 0.5
    chosen[4, 3:] = False
    with np.errstate(over="ignore"):
        apart = np.array([np.sqrt(((x - q) ** 2).sum(axis=1)) for q in queries])
    allowed = chosen & (ids != own[:, None])
    want = [[i for i in np.lexsort((ids, apart[q])) if allowed[q, i]][:6] for q in range(5)]
    for within in (np.full(5, np.inf), np.array([apart[q, w[-1]] for q, w in enumerate(want)])):
        q, row_no, score = permutations.Rerank(ids, x, 6).best(chosen.copy(), own, queries, within)
        assert [row_no[q == i].tolist() for i in range(5)] == want
        assert (score == apart[q, row_no]).all()


def test_measures(spark):
    """Both measures are those of their definitions, and find about as much."""
    x, pivots = spread(300, 7), spread(40, 8).astype(np.float64)
    files, asked = permutations.nearness(x.astype(np.float64), pivots), permutations.nearness(x[:9].astype(np.float64), pivots)
    assert files.max() == 20 and (np.sort(files, axis=1)[:, 20:] == np.arange(1, 21)).all()
    rho = ((files[None].astype(int) - asked[:, None]) ** 2).sum(axis=2)
    assert (permutations._like_rho(files.T.astype(np.float32), asked, 50) == (rho <= np.sort(rho, axis=1)[:, 49, None])).all()
    footrule = np.abs(files[None].astype(int) - asked[:, None]).sum(axis=2)
    assert (permutations._like_footrule(files.T, 20 - asked.astype(np.int16), 50) == (footrule <= np.sort(footrule, axis=1)[:, 49, None])).all()
    rows = given(spark, "/root/testdata/sf0.1")
    index = permutations.PermutationIndex(spark.createDataFrame(rows, "id long, v array<float>"), shard_rows=500)
    chosen, want = spark.createDataFrame([r for r in rows if r[0] % 40 == 0], "id long, v array<float>"), brute(rows, [i for i, _ in rows if i % 40 == 0])
    both = [recall(index.search(chosen, 10, least=10, footrule=kind).collect(), rows, want) for kind in (False, True)]
    assert min(both) >= 0.97
