"""Exact top-k by inner product (operator 7).

The candidates are dealt out to shards of some ``SHARD_ROWS`` rows, and each shard is put into a ball tree. A
node's ball bounds the inner product of a query q with all vectors in it: it is
at most <q, centre> + |q| * radius. A shard with its tree is one row of a table in the shared folder, written once and read once for
all queries. Queries come in blocks of about ``BLOCK_QUERIES``, and the blocks meet a shard by a join on its number, so that a shard is shuffled once. This is always a sort-merge
join: a block stands once for each shard in it, which Spark's estimate of its size doesn't have, so it would be broadcast through the driver.
Queries go down a tree some ``TOGETHER`` at a time. Each one that has no kth score yet looks into the leaf with its highest bound first; then all go
down, the child that is higher for most of them first, and a query leaves a branch whose bound is under its current kth score.

That score is shared. In a first round each block meets one shard only; the kth scores found there are the bounds from below that all
other shards start from in the second round, and a task hands its block's scores on from one shard to the next. The answers of both rounds
are merged at the end.

Vectors are turned into floor(256 * x); null ones, and those with null or
non-finite components, take no part. Scores are exact while the sum of absolute
products stays under 2^53; they are made in 32 bits where norms say that it stays under 2^24.

Edge cases: vectors are compared with those of the same length only; an empty
vector scores 0; an empty table gives an empty table; ties go to the smaller id;
a null id takes no part; repeated rows are candidates like others, each with a rank of its own, and are dealt out by where they stand; rows that
share a query's id are not its candidates, and of several such queries the one
with the smallest vector counts; columns with clashing names are not read. No query and no vector comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundweave.llm.common import saved, small_batches

BLOCK_QUERIES = 16_384
SHARD_ROWS = 16_384
LEAF_ROWS = 128
TOGETHER = 1024
LOWEST = -(2**62)
TREE = "d int, shard int, ids binary, rows binary, centres binary, radii binary, spans binary"
BLOCK = "d int, block int, query_ids binary, queries binary, floors binary"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _written(rows: np.ndarray) -> bytes:
    """Whole numbers in as few bits as hold them."""
    low, high = rows.min(initial=0), rows.max(initial=0)
    return rows.astype(next((kind for kind in (np.int16, np.int32) if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max), np.float64)).tobytes()


def _read(raw: pa.Buffer, n: int, d: int) -> np.ndarray:
    """A matrix of n rows that ``_written`` has made."""
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[raw.size // (n * d) if n * d else 8]
    return np.frombuffer(raw, kind).reshape(n, d)


class BallTree:
    """A ball tree over the rows of a matrix of whole numbers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: list[tuple[np.ndarray, float, int, int, int, int]]):
        self.ids, self.rows, self.nodes = ids, rows, nodes

    @classmethod
    def grown(cls, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        raw, order = rows.astype(np.float64), np.arange(len(rows))
        nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []

        def build(lo: int, hi: int) -> int:
            mine = raw[order[lo:hi]]
            centre = mine.mean(axis=0)
            apart = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append((centre, float(apart.max()), lo, hi, -1, -1))
            if hi - lo > leaf_rows and apart.max() > 0:
                far = mine[apart.argmax()]  # split along the line between two far points
                other = mine[((mine - far) ** 2).sum(axis=1).argmax()]
                order[lo:hi] = order[lo:hi][np.argsort(mine @ (far - other), kind="stable")]
                mid = (lo + hi) // 2
                left, right = build(lo, mid), build(mid, hi)
                nodes[me] = (centre, float(apart.max()), lo, hi, left, right)
            return me

        build(0, len(rows))
        return cls(ids[order], raw[order], nodes)

    def written(self) -> dict[str, bytes]:
        """Columns of a row that holds the tree."""
        return {
            "ids": self.ids.astype(np.int64).tobytes(),
            "rows": _written(self.rows),
            "centres": np.array([n[0] for n in self.nodes], np.float64).tobytes(),
            "radii": np.array([n[1] for n in self.nodes], np.float64).tobytes(),
            "spans": np.array([n[2:] for n in self.nodes], np.int64).tobytes(),
        }

    @classmethod
    def read(cls, d: int, row: dict[str, pa.Scalar]) -> BallTree:
        ids, radii = (np.frombuffer(row[c].as_buffer(), k) for c, k in (("ids", np.int64), ("radii", np.float64)))
        rows = _read(row["rows"].as_buffer(), len(ids), d).astype(np.float64)
        centres = np.frombuffer(row["centres"].as_buffer(), np.float64).reshape(len(radii), d)
        spans = np.frombuffer(row["spans"].as_buffer(), np.int64).reshape(-1, 4).tolist()
        return cls(ids, rows, [(c, float(r), *span) for c, r, span in zip(centres, radii, spans)])


class TopK:
    """The best scores of a block of queries so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.rows, self.k = ids, rows.astype(np.float64), k
        self.norms = np.sqrt((self.rows**2).sum(axis=1))
        self.floor = floor  # known from elsewhere: the kth score is at least this
        self.scores = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), -1, np.int64)

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[at, -1], self.floor[at])

    def search(self, tree: BallTree) -> None:
        centres, radii = np.array([n[0] for n in tree.nodes]), np.array([n[1] for n in tree.nodes])
        leaves = np.array([no for no, n in enumerate(tree.nodes) if n[4] < 0])
        longest = np.sqrt((tree.rows**2).sum(axis=1).max())
        rows = tree.rows.astype(np.float32 if longest * self.norms.max(initial=0) < 2**24 else np.float64)

        def score(node: int, at: np.ndarray) -> None:
            lo, hi = tree.nodes[node][2:4]
            self.merge(at, tree.ids[lo:hi], rows[lo:hi])

        for begin in range(0, len(self.ids), TOGETHER):
            at = np.arange(begin, min(begin + TOGETHER, len(self.ids)))
            bounds = self.rows[at] @ centres.T + self.norms[at, None] * radii
            bounds += 1e-9 * np.abs(bounds) + 1.0  # for rounding; scores are whole numbers
            seen = np.full(len(at), -1)
            blind = np.flatnonzero(self.kth(at) == LOWEST)
            seen[blind] = leaves[bounds[np.ix_(blind, leaves)].argmax(axis=1)]
            for leaf in np.unique(seen[blind]):
                score(leaf, at[seen == leaf])
            todo = [(0, np.arange(len(at)))]
            while todo:
                node, mine = todo.pop()
                mine = mine[(bounds[mine, node] >= self.kth(at[mine])) & (seen[mine] != node)]
                if not len(mine):
                    continue
                left, right = tree.nodes[node][4:]
                if left < 0:
                    score(node, at[mine])
                    continue
                higher = 2 * np.count_nonzero(bounds[mine, left] >= bounds[mine, right]) >= len(mine)
                todo += [(child, mine) for child in ((right, left) if higher else (left, right))]

    def merge(self, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = self.rows[at].astype(rows.dtype) @ rows.T
        q, c = np.nonzero(scores >= self.kth(at).astype(rows.dtype)[:, None])
        others = self.ids[at[q]] != ids[c]
        q, c = q[others], c[others]
        if not len(q):
            return
        some = np.unique(q)
        mine = at[some]
        of = np.concatenate([np.repeat(some, self.k), q])
        made = np.concatenate([self.scores[mine].ravel(), np.rint(scores[q, c]).astype(np.int64)])
        found = np.concatenate([self.found[mine].ravel(), ids[c]])
        order = np.lexsort((found, -made, of))
        best = order[np.searchsorted(of[order], some)[:, None] + np.arange(self.k)]  # those of before are k, so nothing of the next is taken
        self.scores[mine], self.found[mine] = made[best], found[best]


def _matrix(table: pa.Table, d: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), d)


def _grow(key: tuple, rows: pa.Table) -> pa.Table:
    d, shard = (k.as_py() for k in key)
    tree = BallTree.grown(rows.column("id").to_numpy(), _matrix(rows, d))
    return pa.table({"d": pa.array([d], pa.int32()), "shard": pa.array([shard], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in tree.written().items()}})


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    d, block = (k.as_py() for k in key)
    rows = rows.sort_by("id")  # a block made again has its queries in the same places
    columns = {"query_ids": rows.column("id").to_numpy().tobytes(), "queries": _written(_matrix(rows, d)), "floors": rows.column("floor").to_numpy().tobytes()}
    return pa.table({"d": pa.array([d], pa.int32()), "block": pa.array([block], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in columns.items()}})


def _searched(met: DataFrame, k: int) -> DataFrame:
    """The k best of each query of a block in each shard that it has met, as far as they reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple[int, int], np.ndarray] = {}  # by block, with what this task has found so far
        for batch in batches:
            for n in range(len(batch)):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                d, block = row["d"].as_py(), row["block"].as_py()
                ids = np.frombuffer(row["query_ids"].as_buffer(), np.int64)
                queries = _read(row["queries"].as_buffer(), len(ids), d)
                best = TopK(ids, queries, k, floors.get((d, block), np.frombuffer(row["floors"].as_buffer(), np.int64)))
                best.search(BallTree.read(d, row))
                floors[d, block] = np.maximum(best.floor, best.scores[:, -1])
                q, r = np.nonzero((best.scores > LOWEST) & (best.scores >= best.floor[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.found[q, r]), pa.array(best.scores[q, r])], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def _number(by_length: dict[int, int], otherwise: int = 1) -> Column:
    """What a dict has for the length of a vector."""
    pairs = [F.lit(x) for pair in by_length.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col("d")] if pairs else F.lit(None), F.lit(otherwise)).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query`` its k best others."""
    small_batches(vectors.sparkSession)
    one = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), is_query.alias("query"), quantised(F.col(vector)).alias("v")).filter("v IS NOT NULL")
    one = one.withColumn("d", F.size("v"))
    queries = saved(one.filter("query").groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "queries")
    shards = {r["d"]: -(-r["count"] // (shard_rows or SHARD_ROWS)) for r in one.groupBy("d").count().collect()}
    blocks = {r["d"]: -(-r["count"] // (block_queries or BLOCK_QUERIES)) for r in queries.groupBy("d").count().collect()}
    dealt = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), _number(shards)).cast("int")
    trees = saved(one.filter(F.col("d").isin(list(blocks))).withColumn("shard", dealt).select("d", "shard", "id", "v").groupBy("d", "shard").applyInArrow(_grow, TREE), "trees")

    def packed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("id"), _number(blocks)).cast("int")).select("d", "block", "id", "v", "floor").groupBy("d", "block").applyInArrow(_pack, BLOCK)

    home = F.pmod(F.col("block"), _number(shards)).cast("int")
    start = packed(queries.withColumn("floor", F.lit(LOWEST))).withColumn("shard", home)
    first = saved(_searched(trees.join(start.hint("merge"), ["d", "shard"]), k), "first")
    floors = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    known = queries.join(floors.hint("merge"), F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("kth", F.lit(LOWEST)))
    others = packed(known).withColumn("shard", F.explode(F.sequence(F.lit(0), _number(shards) - 1))).filter(F.col("shard") != home)
    parts = 4 * max(1, sum(shards.values()))  # so that few tasks get two shards
    met = others.repartition(parts, "d", "shard").hint("merge").join(trees.repartition(parts, "d", "shard"), ["d", "shard"])
    ranked = first.unionByName(_searched(met, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
