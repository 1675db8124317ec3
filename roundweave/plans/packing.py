"""Queries that pack documents into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave.operators import pack, stats
from roundweave.plans.inputs import table
from roundweave.plans.tables import query

CUTOFF = 2048
LENGTHS_SQL = f"SELECT doc_id, least(len(regexp_extract_all(coalesce(text, ''), '\\S+')), {CUTOFF})::BIGINT AS l FROM documents"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their number of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).alias("words"))
    return pack.packed(docs, "doc_id", F.col("words"), CUTOFF)


#: Best-fit-decreasing, a row for each step: ``rooms[r + 1]`` is the number of blocks with room r, ``lft`` what is left of the i-th length. A
#: block with room r takes r // l samples of length l, the last one maybe fewer.
PACK_SQL = f"""
WITH RECURSIVE w AS ({LENGTHS_SQL}), g AS (SELECT l, count(*) AS n FROM w WHERE l > 0 GROUP BY l
), h AS (SELECT list(l ORDER BY l DESC) AS ls, list(n ORDER BY l DESC) AS ns FROM g
), s(i, lft, rooms) AS (
  SELECT 1::BIGINT, ns[1], list_transform(range({CUTOFF} + 1), lambda x: 0::BIGINT) FROM h WHERE len(ls) > 0
  UNION ALL
  SELECT CASE WHEN lft = took THEN i + 1 ELSE i END, CASE WHEN lft = took THEN ns[i + 1] ELSE lft - took END,
    list_transform(rooms, lambda x, k: x - CASE WHEN there AND k = r + 1 THEN q + (rest > 0)::BIGINT ELSE 0 END + CASE WHEN k = r - e * l + 1 THEN q ELSE 0 END + CASE WHEN rest > 0 AND k = r - rest * l + 1 THEN 1 ELSE 0 END)
  FROM (SELECT *, least(lft, e * b) - q * e AS rest, least(lft, e * b) AS took FROM (SELECT *, least(b, lft // e) AS q FROM (
    SELECT *, r // l AS e, CASE WHEN there THEN rooms[r + 1] ELSE (lft + r // l - 1) // (r // l) END AS b FROM (
      SELECT *, fit IS NOT NULL AS there, coalesce(fit, {CUTOFF}) AS r FROM (
        SELECT s.*, ns, ls[i] AS l, list_filter(range(ls[i], {CUTOFF} + 1), lambda k: rooms[k + 1] > 0)[1] AS fit FROM s, h WHERE i <= len(ls))))))
)"""


@query(f"""{PACK_SQL}, z AS (SELECT rooms FROM s, h WHERE i > len(ls)), r AS (SELECT unnest(range({CUTOFF} + 1)) AS room, unnest(rooms) AS n FROM z)
SELECT {CUTOFF} - room AS fill, n AS blocks FROM r WHERE n > 0""")
def packing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each fill best-fit-decreasing makes of all documents."""
    blocks = _packed(spark, sf_dir).filter("block IS NOT NULL").groupBy("block").agg(F.sum("length").alias("fill"))
    return blocks.groupBy("fill").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"SELECT doc_id, nullif(l, 0) AS length, l > 0 AS packed, CASE WHEN l > 0 THEN true END AS fits FROM ({LENGTHS_SQL})")
def packing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once, cut to the block, and within it."""
    fits = (F.col("offset") >= 0) & (F.col("offset") + F.col("length") <= CUTOFF)
    return _packed(spark, sf_dir).select("doc_id", "length", F.col("block").isNotNull().alias("packed"), fits.alias("fits"))


@query(f"SELECT l AS length, count(*)::BIGINT AS n FROM ({LENGTHS_SQL}) WHERE l > 0 GROUP BY l")
def neat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths that are read back from the masks of the blocks."""
    masks = pack.masks(_packed(spark, sf_dir), CUTOFF)
    return masks.select(F.explode(stats.sequence_lengths(F.col("mask"))).alias("n")).groupBy(F.col("n").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{PACK_SQL}, z AS (SELECT rooms FROM s, h WHERE i > len(ls)), r AS (SELECT unnest(range({CUTOFF} + 1)) AS room, unnest(rooms) AS n FROM z)
SELECT sum(n)::BIGINT AS blocks, (SELECT count(*) FROM w WHERE l > 0)::BIGINT AS samples, (SELECT sum(l) FROM w)::BIGINT AS places, sum(room * n)::BIGINT AS padding FROM r""")
def plain_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, samples, and places with and without a token, counted on masks that don't tell samples apart."""
    rows = _packed(spark, sf_dir)
    masks = pack.masks(rows, CUTOFF, neat=False).select(F.size(stats.unpadded(F.col("mask"))).alias("n"))
    counted = masks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("places"), F.sum(CUTOFF - F.col("n")).alias("padding"))
    return counted.crossJoin(F.broadcast(rows.agg(F.count("block").alias("samples"))))
