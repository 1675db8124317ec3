"""Whitening against covariances in whole numbers of any size."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from roundweave.llm import queries, whitening
from tests.conftest import SF, same_rows


def exact(vectors):
    """n * x - S of vectors, and their covariance, in Python's whole numbers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(row, sums)] for row in x]
    d = len(sums)
    return y, np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])


def check(rows, got, k=8):
    """The contract, for one list of vectors of one length; (id, vector) without ties of ids."""
    y, cov = exact([v for _, v in rows])
    n, d = len(rows), len(cov)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == n * min(k, d)
    want = np.array(y, float) / n @ axes / np.sqrt(values)
    ours = np.array([[by[i, c + 1]["whitened"] for c in range(min(k, d))] for i, _ in rows])
    np.testing.assert_allclose(ours * np.sign((ours * want).sum(axis=0)), want, rtol=1e-6, atol=1e-6)
    for (i, _), row in zip(rows, y):
        for c in range(min(k, d)):
            r = by[i, c + 1]
            deviation = sum(v * v for v in row)
            assert r["n"] == n and r["deviation"] == (deviation if deviation < 2**63 else None)
            assert abs(r["explained"] / (values[c] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, queries.op11_whitening(spark, SF).collect())


def test_sql(spark, duck):
    same_rows(queries.whitening_deviation(spark, SF).toPandas(), duck.sql(queries.ORACLES["whitening_deviation"]).df())


@pytest.mark.parametrize("scale, d", [(1e-3, 3), (1.0, 12), (1e6, 4), (1e13, 3)])
def test_scales(spark, scale, d):
    """Numbers of one to many digits, over many tasks."""
    rng = random.Random(d)
    rows = [(i, [rng.gauss(5, 1) * scale * (c + 1) for c in range(d)]) for i in range(150)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect())


@pytest.mark.parametrize("bits", [1, 19, 20, 45, 61, 90])
def test_slices_are_exact(bits):
    """Digits make up their number again, and products of digits those of the numbers."""
    rng = random.Random(bits)
    numbers = [[rng.randint(-(2**bits), 2**bits) for _ in range(3)] for _ in range(50)]
    y = np.array(numbers, np.int64 if bits < 62 else object)
    parts = whitening.limbs(y, 2**bits)
    for r, row in enumerate(numbers):
        assert [sum(int(p[r, c]) << (20 * at) for at, p in enumerate(parts)) for c in range(3)] == row
    planes = whitening.gram(parts)
    for i in range(3):
        for j in range(3):
            assert sum(int(p[i, j]) << (20 * at) for at, p in enumerate(planes)) == sum(row[i] * row[j] for row in numbers)


def test_blocks():
    """Batches come out as blocks of one length, every row once and with its key."""
    rows = [(i, [float(i)] * (2 + i % 3)) for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([v for _, v in part], pa.list_(pa.float64()))], names=["vec_id", "v"]) for part in (rows[:7], rows[7:20], rows[20:])]
    seen = []
    for d, keys, x in whitening._blocks(iter(batches), 6):
        assert x.shape == (len(keys), d) and len(x) <= 6
        seen += [(key, [float(v - 100_000) / 1024 for v in row]) for key, row in zip(keys.to_pylist(), x)]
    assert sorted(seen) == rows


def test_no_cancellation(spark):
    """A spread of 2^-10 around 10^9: squares in floating point would have lost it."""
    rows = [(i, [1e9 + (i % 7) / 1024, 1e9 + (i * i % 11) / 1024]) for i in range(77)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    schema = "vec_id long, embedding array<double>, d long, n string, v int, w int, whitened int"
    odd = [(3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, []), (9, [1e300, 1.0])]
    pairs = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (None, [0.0, 0.25]), (2, [-1.0, 0.75])]
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in odd + pairs + [(7, [2.0])]], schema)
    got = whitening.whiten(table).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 4), (0, 2, 4), (1, 1, 4), (1, 1, 4), (1, 2, 4), (1, 2, 4), (2, 1, 4), (2, 2, 4), (7, 1, 1)]
    y, _ = exact([v for _, v in pairs])
    assert sorted(r["deviation"] for r in got if r["component"] == 1 and r["n"] == 4) == sorted(sum(c * c for c in row) for row in y)
    (alone,) = [r for r in got if r["vec_id"] == 7]
    assert alone["deviation"] == 0 and alone["whitened"] is None and alone["explained"] is None and alone["identity_error"] is None
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.filter("vec_id > 2 AND vec_id < 7")).collect() == []


def test_constant_dimension(spark):
    """A dimension that never changes has no scale; the others are whitened as if it weren't there."""
    rows = [(i, [float(i % 5), 3.0, float(i * i % 7)]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got) and all(r["explained"] == 0 for r in got if r["component"] == 3)
