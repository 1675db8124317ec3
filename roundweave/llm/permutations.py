"""Approximate nearest neighbours by a permutation index (operator 12).

``PIVOTS`` vectors are drawn as pivots. A vector is represented by the nearer half of them, in the order of their distances: near vectors
see the pivots in a like order. The table is dealt out to shards of some ``SHARD_ROWS`` rows, and each shard has one inverted file
for each pivot: how near the pivot stands for each row of the shard, l for the nearest of l pivots, 0 for the farther half. A shard with its vectors and files is one row of the index, a table
in the shared folder that any number of searches can read.

A search takes the queries in blocks, and each block meets each shard once (a sort-merge join on the shard; no vector is met
outside of its shard, and nothing is broadcast but the pivots). Orders are compared by Spearman's rho: with those numbers its square is 2 * (1 + 4 + ... + l * l) less twice the
sum of their products over the pivots that both have, so it adds up over the inverted files, as a matrix product. ``footrule=True`` compares by the footrule distance instead, the sum of l - max(place, place),
which is no product and takes some twenty times as long; recall is the same. The ``SHARE`` of a shard that is nearest by that, at least ``LEAST`` rows of it and whatever ties with the last of them, is reranked by
Euclidean distance on the original vectors; the k best of each shard are merged. Reranking looks first at distances in 32 bits, with a bound on their error, and then takes in double precision what may be among the k best.

Only the pivots are fitted on a sample: those with the smallest hashes among the distinct vectors with the smallest hashes (some ``SAMPLE``).
Every row is indexed. Recall is measured against brute force in the tests and given in the README: the given vectors are spread over the sphere almost evenly
(the tenth neighbour is at 0.73 of the mean distance), which is why so large a share is reranked.

Edge cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, and neither do rows with a null id; vectors
are compared with those of the same length only; repeated rows are candidates like others, each with a rank of its own; rows that share a
query's id are not its candidates, and of several such queries the one with the smallest vector counts; ties go to the smaller id. A query without
candidates has no row; an empty table gives an empty table. Components whose squares overflow give infinite distances. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundweave.llm.common import saved, small_batches

PIVOTS = 256
SAMPLE = 4096
SHARD_ROWS = 16_384
BLOCK_QUERIES = 16_384
#: The share of a shard that is reranked, and the least number of rows. With 1/4 recall is 0.96 where a third of the rows are near copies (``check_h``) and 0.998
#: and more on the other given tables; with 1/8 it is 0.89 and 0.987.
SHARE = 1 / 4
LEAST = 256
#: Queries whose sums are held at once.
TOGETHER = 256
#: Distances that are taken in double precision at once.
PAIRS = 1 << 16
SHARD = "d int, shard int, ids binary, vectors binary, files binary"
BLOCK = "d int, block int, query_ids binary, queries binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in the order of each vector; those of the farther half all have the number of the nearer half."""
    near = -(-len(pivots) // 2)
    with np.errstate(all="ignore"):
        apart = (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    order = np.argsort(apart, axis=1, kind="stable")[:, :near]
    found = np.full((len(vectors), len(pivots)), near, np.int16)
    np.put_along_axis(found, order, np.arange(near, dtype=np.int16)[None, :], axis=1)
    return found


def nearness(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For every vector and pivot l less the pivot's place, which is 0 for the farther half."""
    near = -(-len(pivots) // 2)
    return (near - places(vectors, pivots)).astype(np.uint8 if near < 256 else np.uint16)


def _matrix(table: pa.Table, d: int) -> np.ndarray:
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return v if v.dtype == np.float32 else v.astype(np.float64)


class PermutationIndex:
    """The index of a table of ``id, v``, and searches in it."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS):
        self.spark = vectors.sparkSession
        vectors = vectors.withColumn("d", F.size("v"))
        counts = vectors.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("distinct")).collect()
        self.shards = {r["d"]: -(-r["n"] // shard_rows) for r in counts}
        self.pivots = self._drawn(vectors, {r["d"]: SAMPLE / r["distinct"] for r in counts}, pivots)
        # rows that nothing tells apart are dealt out by where they stand
        dealt = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), self._of(self.shards)).cast("int")
        shared = self.spark.sparkContext.broadcast(self.pivots)

        def post(key: tuple, rows: pa.Table) -> pa.Table:
            d, shard = (k.as_py() for k in key)
            mine = _matrix(rows, d)
            files = nearness(mine.astype(np.float64), shared.value[d]).T
            return pa.table({"d": pa.array([d], pa.int32()), "shard": pa.array([shard], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", rows.column("id").to_numpy()), ("vectors", mine), ("files", files))}})

        self.table = saved(vectors.withColumn("shard", dealt).groupBy("d", "shard").applyInArrow(post, SHARD), "shards")

    def _of(self, by_length: dict[int, int]) -> Column:
        """What a dict has for the length of a vector; 1 for those it doesn't have."""
        pairs = [F.lit(x) for pair in by_length.items() for x in pair]
        return F.coalesce(F.create_map(*pairs)[F.col("d")] if pairs else F.lit(None), F.lit(1)).cast("int")

    def _drawn(self, vectors: DataFrame, shares: dict[int, float], most: int) -> dict[int, np.ndarray]:
        """So many distinct vectors of each length."""
        hashed = vectors.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(12), "v"), 11))
        pairs = [F.lit(x) for d, share in shares.items() for x in (d, int(min(1.0, share) * 2**53))]
        if not pairs:
            return {}
        few = hashed.filter(F.col("h") <= F.create_map(*pairs)[F.col("d")]).select("d", "h", "v").distinct()
        drawn = few.withColumn("no", F.row_number().over(Window.partitionBy("d").orderBy("h", "v"))).filter(F.col("no") <= most)
        found: dict[int, list] = {}
        for r in sorted(drawn.collect(), key=lambda r: r["no"]):
            found.setdefault(r["d"], []).append(r["v"])
        return {d: np.array(v, np.float64) for d, v in found.items()}

    def search(self, queries: DataFrame, k: int, share: float = SHARE, least: int = LEAST, block_queries: int = BLOCK_QUERIES, footrule: bool = False) -> DataFrame:
        """``query_id, rank, vec_id, score`` for queries ``id, v``; one that has an id of the index is not its own neighbour."""
        one = queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
        blocks = {r["d"]: -(-r["count"] // block_queries) for r in one.groupBy("d").count().collect()}

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            d, block = (k.as_py() for k in key)
            rows = rows.sort_by("id")  # a block made again has its queries in the same places
            return pa.table({"d": pa.array([d], pa.int32()), "block": pa.array([block], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("query_ids", rows.column("id").to_numpy()), ("queries", _matrix(rows, d)))}})

        packed = one.withColumn("block", F.pmod(F.xxhash64("id"), self._of(blocks)).cast("int")).groupBy("d", "block").applyInArrow(pack, BLOCK)
        packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), self._of(self.shards) - 1)))
        shared = self.spark.sparkContext.broadcast(self.pivots)
        parts = 4 * max(1, sum(self.shards.values()))  # so that few tasks get two shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            within: dict[tuple[int, int], np.ndarray] = {}  # the kth distance that this task has seen, by block
            for batch in batches:
                for n in range(len(batch)):
                    row = {c: batch.column(c)[n] for c in batch.schema.names}
                    d, block = row["d"].as_py(), row["block"].as_py()
                    found, within[d, block] = _met(row, shared.value[d], k, share, least, within.get((d, block)), footrule)
                    yield found

        met = packed.repartition(parts, "d", "shard").hint("merge").join(self.table.repartition(parts, "d", "shard"), ["d", "shard"])
        near = met.mapInArrow(run, "query_id long, vec_id long, score double")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(row: dict[str, pa.Scalar], pivots: np.ndarray, k: int, share: float, least: int, within: np.ndarray | None, footrule: bool) -> tuple[pa.RecordBatch, np.ndarray]:
    """The k nearest that a block of queries finds in a shard, if not farther than ``within``; and the kth distance of each query so far."""
    d = row["d"].as_py()
    ids, query_ids = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("ids", "query_ids"))
    vectors, queries = _vectors(row["vectors"].as_buffer(), len(ids), d), _vectors(row["queries"].as_buffer(), len(query_ids), d)
    raw = row["files"].as_buffer()
    files = np.frombuffer(raw, np.uint8 if raw.size == len(ids) * len(pivots) else np.uint16).reshape(len(pivots), len(ids))
    if not footrule:
        near = int(files.max())
        files = files.astype(np.float32 if near * (near + 1) * (2 * near + 1) // 6 < 2**24 else np.float64)  # which holds the sums of products
    few = min(len(ids), max(least, ceil(share * len(ids))))
    rerank = Rerank(ids, vectors, k)
    within = np.full(len(queries), np.inf) if within is None else within.copy()
    made = []
    for a in range(0, len(queries), TOGETHER):
        at = slice(a, a + TOGETHER)
        chosen = _like_footrule(files, places(queries[at], pivots), few) if footrule else _like_rho(files, nearness(queries[at], pivots), few)
        q, row_no, score = rerank.best(chosen, query_ids[at], queries[at], within[at])
        made.append((query_ids[at][q], ids[row_no], score))
        last = np.flatnonzero(np.bincount(q, minlength=len(chosen)) == k)
        within[a + last] = np.minimum(within[a + last], score[np.searchsorted(q, last, side="right") - 1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=["query_id", "vec_id", "score"]), within


def _vectors(raw: pa.Buffer, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw.size == 4 * d * n else np.float64).reshape(n, d).astype(np.float64)


class Rerank:
    """The vectors of a shard, for distances from queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.by_id = np.argsort(ids, kind="stable")
        with np.errstate(over="ignore"):
            squares = (vectors**2).sum(axis=1)
            self.longest = squares.max()
            self.terms = np.concatenate([vectors.astype(np.float32), squares.astype(np.float32)[:, None]], axis=1).T

    def best(self, chosen: np.ndarray, own: np.ndarray, queries: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and distance of the k nearest among the chosen rows of each query, by query, distance and id; those farther than ``within`` may be left out."""
        n = len(self.ids)
        with np.errstate(over="ignore"):
            squares = (queries**2).sum(axis=1)
        first, last = (np.searchsorted(self.ids, own, side, sorter=self.by_id) for side in ("left", "right"))
        same = np.repeat(np.arange(len(own)), last - first)
        chosen[same, self.by_id[np.arange(len(same)) - np.repeat(np.cumsum(last - first) - last, last - first)]] = False
        if max(squares.max(), self.longest) < 1e37:  # squares of distances, less that of the query, in 32 bits
            apart = np.concatenate([-2 * queries, np.ones((len(queries), 1))], axis=1).astype(np.float32) @ self.terms
            error = 4 * (queries.shape[1] + 8) * 2.0**-24 * (squares + self.longest) + 1e-40
            limit = within**2 * (1 + 1e-12) - squares + error
            blind = np.flatnonzero(np.isinf(within))
            if len(blind) and n > self.k:
                limit[blind] = np.partition(np.where(chosen[blind], apart[blind], np.inf), self.k - 1, axis=1)[:, self.k - 1] + 2 * error[blind]
            chosen &= apart <= limit.astype(np.float32)[:, None]
        made, begin = [], 0
        for end in np.flatnonzero(np.diff(np.cumsum(np.count_nonzero(chosen, axis=1)) // PAIRS, append=-1)) + 1:
            q, row_no = np.divmod(np.flatnonzero(chosen[begin:end]), n)
            q += begin
            with np.errstate(over="ignore"):
                score = np.sqrt(((self.vectors[row_no] - queries[q]) ** 2).sum(axis=1))
            order = np.lexsort((self.ids[row_no], score, q))
            q = q[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
            made.append((q[kept], row_no[order][kept], score[order][kept]))
            begin = end
        return tuple(map(np.concatenate, zip(*made)))


def _like_rho(files: np.ndarray, orders: np.ndarray, few: int) -> np.ndarray:
    """Which rows of a shard are the few nearest by Spearman's rho, or tie with them, for each query's order."""
    common = orders.astype(files.dtype) @ files
    n = common.shape[1]
    if few >= n:
        return np.ones_like(common, bool)
    return common >= np.partition(common, n - few, axis=1)[:, n - few, None]


def _like_footrule(files: np.ndarray, orders: np.ndarray, few: int) -> np.ndarray:
    """The same by the footrule."""
    pivot, rows = np.nonzero(files)
    ends = np.cumsum(np.bincount(pivot, minlength=len(files)))
    at = (-(-len(files) // 2) - files[pivot, rows].astype(np.int64)).astype(np.int16)
    return _like(ends, rows, at, orders, files.shape[1], few).T.copy()


def _like(ends: np.ndarray, rows: np.ndarray, at: np.ndarray, orders: np.ndarray, n: int, few: int) -> np.ndarray:
    """Which of a shard's n rows are the few nearest by footrule, or tie with them, for each query's order."""
    near = -(-orders.shape[1] // 2)
    common = np.zeros((n, len(orders)), np.int16)  # l * (l + 1) less this twice is the footrule distance
    begin = 0
    for pivot, end in enumerate(ends):
        common[rows[begin:end]] += near - np.maximum(at[begin:end, None], orders[None, :, pivot])
        begin = end
    if few >= n:
        return np.ones_like(common, bool)
    return common >= np.partition(common, n - few, axis=0)[n - few]


def nearest(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query`` its k nearest others, as far as found."""
    small_batches(rows.sparkSession)
    kept = rows.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    taken = [F.col(key).cast("long").alias("id"), F.col(vector).alias("v")]
    return PermutationIndex(kept.select(*taken)).search(kept.filter(is_query).select(*taken), k)
