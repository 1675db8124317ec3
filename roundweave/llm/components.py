"""Connected components of a graph given by its edges.

Alternating large-star and small-star steps: each is a minimum per node, which
Spark sums up before it shuffles, and a join, whose hot keys it splits. Every
round is written to the shared folder, which cuts the lineage, and the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundweave.llm.common import discard, saved


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: every node that is not the smallest of its component, with the smallest.

    ``edges`` has two columns of longs, without nulls.
    """
    a, b = (F.col(c) for c in edges.columns)
    stars = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = _digest(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, stars = stars, saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        after = _digest(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
