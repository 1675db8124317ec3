"""Whitening of embeddings from exact covariances (operator 11).

Each component c becomes the whole number x = floor(1024 * c) + 100000. A first pass has the count n and, per dimension, the sums S and
the extremes. A second pass centres before it multiplies: y = n * x - S is n times the distance of x from its mean, and
a whole number. y is cut into balanced digits of ``LIMB_BITS`` bits, a float64 matrix each. The products of two such
matrices are exact, as ``BLOCK_ROWS`` products of two digits stay under 2^53, so BLAS does the work and nothing is rounded (digit-slice
GEMM). Products of equal weight are added up and carried, so that the sum of a task is a big integer in planes of
``LIMB_BITS`` bits; Spark adds up the planes of all tasks by dimension pair, with partial sums, and the driver recombines one big integer
for each. It is rounded once, when n^3 divides it; the eigenvectors are those of that matrix.

A third pass projects y / n, and writes the deviations and at most ``k`` whitened components, which are small beside their vectors; the covariance
of what was written is what ``identity_error`` is measured on.

Driver: d * (d + 1) / 2 big integers and a d x d matrix for dimension d, whatever the number of rows.

Edge cases: vectors that are null or hold null or non-finite entries take no part, nor do those with an entry of
2^50 or more (its x has no room for exact arithmetic). Vectors of another length are a fit list of their own. Empty vectors give no row.
Null ids and repeated rows are rows like others. A component without variance (an eigenvalue that rounding alone could make) has no scale:
``whitened`` is null, and it isn't part of ``identity_error``, which is null if there is no other; ``explained`` is null where
all vectors are equal. A deviation of 2^63 or more doesn't fit its column and is null. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.llm.common import saved, small_batches

SCALE, SHIFT = 1024, 100_000
#: Bits of a digit, and the rows that are multiplied at once: 2^13 * 2^19 * 2^19 < 2^53.
LIMB_BITS = 20
BLOCK_ROWS = 8192
LARGEST = 2.0**50


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return vector.isNotNull() & ~bad & (F.size(vector) > 0)


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_ROWS) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Length, keys and whole numbers of vectors, by length, at most so many at once."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut() -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        keys = pa.concat_arrays([b.column(0) for b in held])
        lists = pa.concat_arrays([b.column(1) for b in held])
        lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths):
            mine = np.flatnonzero(lengths == d)
            for i in range(0, len(mine), most):
                part = mine[i : i + most]
                c = flat[starts[part][:, None] + np.arange(d)].astype(np.float64)
                yield int(d), keys.take(pa.array(part)), np.floor(c * SCALE).astype(np.int64) + SHIFT

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            yield from cut()
            held, rows = [], 0
    if rows:
        yield from cut()


def moments(vectors: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """For each length of vectors: n, the sums of the dimensions, and the largest distance between two values of a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for d, _, x in _blocks(batches):
            # sums of halves stay small, however large the table is
            now = [len(x) * np.ones(d, np.int64), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            was = sums.setdefault(d, now)
            if was is not now:
                sums[d] = [was[0] + now[0], was[1] + now[1], was[2] + now[2], np.minimum(was[3], now[3]), np.maximum(was[4], now[4])]
        for d, columns in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), *map(pa.array, columns)], names=["d", "i", "n", "high", "low", "least", "most"])

    parts = vectors.mapInArrow(run, "d long, i long, n long, high long, low long, least long, most long")
    of_all = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
    found: dict[int, tuple[int, list[int], int]] = {}
    for r in sorted(of_all.collect(), key=lambda r: (r["d"], r["i"])):
        n, sums, spread = found.get(r["d"], (r["n"], [], 0))
        found[r["d"]] = (n, sums + [(r["high"] << 32) + r["low"]], max(spread, r["most"] - r["least"]))
    return found


def centred(x: np.ndarray, n: int, sums: list[int], spread: int) -> np.ndarray:
    """n * x - S, in 64 bits where that has room, else in Python's whole numbers."""
    means = [s // n for s in sums]
    kind = np.int64 if n * (spread + 2) < 2**62 else object
    rest = np.array([s - n * m for s, m in zip(sums, means)], kind)
    return (x - np.array(means, np.int64)).astype(kind) * n - rest


def limbs(y: np.ndarray, spread: int) -> list[np.ndarray]:
    """Balanced digits of whole numbers of at most ``spread``, the lowest first, as float64."""
    found, half = [], 1 << (LIMB_BITS - 1)
    while spread:
        digit = ((y + half) & ((1 << LIMB_BITS) - 1)) - half
        found.append(digit.astype(np.float64))
        y = (y - digit) >> LIMB_BITS
        spread = (spread + half) >> LIMB_BITS
    return found


def carried(planes: np.ndarray) -> np.ndarray:
    """Planes with digits of ``LIMB_BITS`` bits, the last one with what is left."""
    planes = planes.copy()
    for p in range(len(planes) - 1):
        up = planes[p] >> LIMB_BITS
        planes[p] -= up << LIMB_BITS
        planes[p + 1] += up
    return planes


def gram(parts: list[np.ndarray]) -> np.ndarray:
    """Planes of the products of all pairs of columns, exact; ``parts`` are digits of the columns."""
    d = parts[0].shape[1]
    planes = np.zeros((2 * len(parts) + 1, d, d), np.int64)
    for a, one in enumerate(parts):
        for b in range(a, len(parts)):
            product = (one.T @ parts[b]).astype(np.int64)
            planes[a + b] += product if a == b else product + product.T
    return carried(planes)


def covariances(vectors: DataFrame, known: dict[int, tuple[int, list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the covariance matrix, each entry the exact one, rounded once."""
    planes = 2 * max((len(limbs(np.zeros((1, 1), np.int64), n * spread)) for n, _, spread in known.values()), default=0) + 3
    names = [f"p{p}" for p in range(planes)]
    shared = vectors.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, _, x in _blocks(batches):
            n, s, spread = shared.value[d]
            parts = limbs(centred(x, n, s, spread), n * spread)
            if parts:
                mine = gram(parts)
                held = sums.setdefault(d, np.zeros((planes, d, d), np.int64))
                held[: len(mine)] += mine
                sums[d] = carried(held)
        for d, held in sums.items():
            i, j = np.triu_indices(d)
            for a in range(0, len(i), 1 << 14):
                r, c = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), d)), pa.array(r), pa.array(c), *(pa.array(held[p, r, c]) for p in range(planes))], names=["d", "i", "j", *names])

    parts = vectors.mapInArrow(run, ", ".join(f"{c} long" for c in ["d", "i", "j", *names]))
    found = {d: np.zeros((d, d)) for d in known}
    for r in parts.groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in names)).toLocalIterator():
        total = sum(r[c] << (LIMB_BITS * p) for p, c in enumerate(names))
        found[r["d"]][r["i"], r["j"]] = found[r["d"]][r["j"], r["i"]] = total / known[r["d"]][0] ** 3
    return found


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (0 where rounding alone could make them), unit eigenvectors in columns, and explained shares of the first k components."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(np.trace(cov))
    kept = np.where(values > len(cov) * np.finfo(float).eps * trace, values, 0.0)
    return kept, vectors * signs, kept / trace if trace > 0 else np.full(len(kept), np.nan)


def _whitened(vectors: DataFrame, known: dict, fits: dict, k: int) -> DataFrame:
    """``vec_id, d, n, deviation, w``: the whitened components of each vector in one array."""
    shared = vectors.sparkSession.sparkContext.broadcast((known, fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fits = shared.value
        for d, keys, x in _blocks(batches):
            n, sums, spread = known[d]
            values, axes, _ = fits[d]
            y = centred(x, n, sums, spread)
            wide = y if d * (n * spread) ** 2 < 2**63 else y.astype(object)
            deviation = [int(v) if v < 2**63 else None for v in (wide * wide).sum(axis=1)]
            with np.errstate(divide="ignore", invalid="ignore"):
                w = ((y / n).astype(np.float64) @ axes) / np.sqrt(values)
            w[:, values == 0] = np.nan
            flat = pa.array(w.reshape(-1), pa.float64(), mask=np.isnan(w.reshape(-1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            same = [pa.array(np.full(len(w), v, np.int64)) for v in (d, n)]
            yield pa.RecordBatch.from_arrays([keys, *same, pa.array(deviation, pa.int64()), lists], names=["vec_id", "d", "n", "deviation", "w"])

    return vectors.mapInArrow(run, "vec_id long, d long, n long, deviation long, w array<double>")


def identity_errors(made: DataFrame, k: int) -> dict[int, float | None]:
    """For each length the largest entry of the whitened covariance minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = [F.get("w", F.lit(i)) for i in range(k)]
    entries = [F.abs(F.covar_pop(at[i], at[j]) - float(i == j)).alias(f"c{i}_{j}") for i, j in pairs]
    # a component without variance is null in all rows, and so is its covariance
    return {r["d"]: max((e for e in r[1:] if e is not None), default=None) for r in made.groupBy("d").agg(*entries).collect()}


def whiten(rows: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: up to k components of every vector."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    known = moments(vectors)
    fits = {d: components(cov, k) for d, cov in covariances(vectors, known).items()}
    made = saved(_whitened(vectors, known, fits, k), "whitened")
    errors = identity_errors(made, k)
    of_length = spark.createDataFrame([(d, c + 1, None if np.isnan(share) else float(share), errors.get(d)) for d, (_, _, shares) in fits.items() for c, share in enumerate(shares)], "__d long, __c int, explained double, identity_error double")
    each = made.select("vec_id", "d", "n", "deviation", F.posexplode("w").alias("__at", "whitened")).withColumn("component", F.col("__at") + 1)
    found = each.join(F.broadcast(of_length), (F.col("d") == F.col("__d")) & (F.col("component") == F.col("__c")))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
