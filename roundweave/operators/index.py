"""An index over several sources: which row of which source stands at a position.

Positions run through the sources one after the other. A source that is resampled to m entries of its n rows has them by systematic sampling: entry j is row
floor(j * n / m), counted on from an offset that the seed gives. So each row comes floor(m / n) or ceil(m / n) times, exactly m
entries in all, and neither the entries nor their order are ever stored: both directions are arithmetic. Rows
need a dense number from 0 (``sources.with_numbers`` or ``select.numbered`` give one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.operators.select import positions


def entries(n: int, size: int | None = None, weight: float | None = None) -> int:
    """How many entries n rows have: the size, if given, then that times the weight, rounded (halves up)."""
    if (size is not None and size < 0) or (weight is not None and weight < 0):
        raise ValueError("size and weight can't be negative")
    made = n if size is None else size
    made = made if weight is None else int(made * weight + 0.5)
    if made and not n:
        raise ValueError("a source without rows can't be resampled")
    return made


def offset(n: int, m: int, seed: int) -> int:
    """The row that sampling starts from: 0 for a negative seed, and where every row comes equally often."""
    return 0 if not n or m % n == 0 or seed < 0 else int(hashlib.md5(f"{seed}:{n}:{m}".encode()).hexdigest(), 16) % n


def _product(a: Column, b: int) -> Column:
    """Products of two whole numbers don't fit 64 bits at scale."""
    return a.cast("decimal(19,0)") * F.lit(b).cast("decimal(19,0)")


def _quotient(a: Column, b: int, up: bool = False) -> Column:
    exact = (a + F.lit(b - 1 if up else 0).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.call_function("div", exact, F.lit(b).cast("decimal(38,0)"))


def row_of(entry: Column, n: int, m: int, seed: int = 0) -> Column:
    """The row that an entry is."""
    return entry if n == m else F.pmod(_quotient(_product(entry, n), m) + offset(n, m, seed), F.lit(n))


def entries_of(row: Column, n: int, m: int, seed: int = 0) -> Column:
    """The entries that a row has, ascending."""
    if n == m:
        return F.array(row)
    at = F.pmod(row - offset(n, m, seed), F.lit(n))
    first, end = _quotient(_product(at, m), n, up=True), _quotient(_product(at + 1, m), n, up=True)
    return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def resampled(rows: DataFrame, key: str, n: int, size: int | None = None, weight: float | None = None, seed: int = 0, name: str = "entry") -> DataFrame:
    """``rows`` with a dense number ``key``, each as often as it is drawn, with the number of its entry. Nothing is shuffled or sorted."""
    m = entries(n, size, weight)
    return rows.withColumn(name, F.explode(entries_of(F.col(key).cast("long"), n, m, seed))) if n else rows.withColumn(name, F.col(key).cast("long"))


class SourceIndex:
    """Positions over sources, in the order of their names' dict.

    ``counts`` has the rows of each source. ``convert`` has for a source what makes samples of its rows. A streaming index has
    no length and no positions.
    """

    def __init__(self, named: dict[str, DataFrame], key: str, counts: dict[str, int], sizes: dict[str, int] | None = None, weights: dict[str, float] | None = None, seed: int = 0, convert: dict[str, Callable[[DataFrame], DataFrame]] | None = None, streaming: bool = False):
        self.named, self.key, self.seed, self.streaming = named, key, seed, streaming
        self.convert = convert or {}
        self.rows = [counts[name] for name in named]
        self.size = [entries(counts[name], (sizes or {}).get(name), (weights or {}).get(name)) for name in named]
        self.start = [sum(self.size[:i]) for i in range(len(self.size))]

    def __len__(self) -> int:
        if self.streaming:
            raise TypeError("a streaming index has no length")
        return sum(self.size)

    def length(self) -> int:
        """Number of positions; -1 if streaming."""
        return -1 if self.streaming else len(self)

    def _sample(self, no: int, rows: DataFrame) -> DataFrame:
        """Rows of a source as samples with the source's name. What a converter gets has all columns, and it has to keep ``at``."""
        name = list(self.named)[no]
        rows = rows.drop(self.key)
        return (self.convert[name](rows) if name in self.convert else rows).withColumn("_dataset_name", F.lit(name))

    def _together(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:  # nothing is asked for
            parts = [self._sample(0, next(iter(self.named.values())).limit(0).withColumn("at", F.lit(0).cast("long")))]
        made = parts[0]
        for p in parts[1:]:
            made = made.unionByName(p, allowMissingColumns=True)
        return made

    def entries(self) -> DataFrame:
        """All samples with their positions ``at``, in no order."""
        if self.streaming:
            raise ValueError("a streaming index has no positions")
        return self._together([self._sample(no, resampled(rows, self.key, self.rows[no], self.size[no], seed=self.seed, name="at").withColumn("at", F.col("at") + self.start[no])) for no, rows in enumerate(self.named.values()) if self.size[no]])

    def select(self, index: int | slice | list[int]) -> DataFrame:
        """Samples at positions, with their place ``at`` in what was asked for; repeats and order are kept.

        A slice is a range on the cluster, whatever its length; a list comes from the driver. A position is looked up
        in the ranges of the sources, and only sources that are asked for are read, between the first and the last row asked for.
        """
        if self.streaming:
            raise ValueError("a streaming index has no positions")
        spark = next(iter(self.named.values())).sparkSession
        if isinstance(index, slice):
            start, stop, step = index.indices(len(self))
            asked = range(start, stop, step)
            wanted = spark.range(len(asked)).select(F.col("id").alias("at"), (F.col("id") * step + start).alias("__p"))
            spans = [(min(asked[0], asked[-1]), max(asked[0], asked[-1]))] if asked else []
            between = lambda lo, hi: [(max(lo, a), min(hi, b)) for a, b in spans if a <= hi and b >= lo]
        else:
            found = positions(index, len(self))
            wanted = spark.createDataFrame(list(enumerate(found)), "at long, __p long")
            between = lambda lo, hi: [(min(mine), max(mine))] if (mine := [p for p in found if lo <= p <= hi]) else []
        parts = []
        for no, rows in enumerate(self.named.values()):
            first, n, m = self.start[no], self.rows[no], self.size[no]
            for lo, hi in between(first, first + m - 1):
                mine = wanted.filter(F.col("__p").between(lo, hi)).select("at", row_of(F.col("__p") - first, n, m, self.seed).alias("__row"))
                rows = rows.filter(F.col(self.key).between(lo - first, hi - first)) if n == m else rows
                parts.append(self._sample(no, mine.join(rows, F.col("__row") == F.col(self.key)).drop("__row")))
        return self._together(parts)
