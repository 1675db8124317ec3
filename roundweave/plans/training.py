"""Queries over orders by chance, media and the cost of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave.operators import select, stats
from roundweave.plans.inputs import table
from roundweave.plans.tables import query
from roundweave.sources import media


@query("""SELECT doc_id, row_number() OVER (ORDER BY md5('11:' || doc_id), doc_id) - 1 AS "at" FROM documents""")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in an order by chance."""
    rows = select.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 11)
    numbered = rows.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    # rows come out part by part, so their places follow from the rows that parts have
    return select.numbered(numbered, "line", "at").select("doc_id", "at")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
p AS (SELECT doc_id, i, i + floor(('0x' || substr(md5('4:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 64)::BIGINT AS place FROM d)
SELECT doc_id, row_number() OVER (ORDER BY place, md5('4:' || i)) - 1 AS "at" FROM p""")
def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents after a shuffle with a buffer of 64 rows."""
    rows = select.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "i")
    made = select.buffer_shuffled(rows, "i", 64, 4).withColumn("line", F.monotonically_increasing_id())
    return select.numbered(made, "line", "at").select("doc_id", "at")


@query("""SELECT doc_id, concat('data:', CASE lang WHEN 'en' THEN 'image/png' WHEN 'de' THEN 'image/webp' WHEN 'fr' THEN 'text/plain' ELSE 'image/jpeg' END, ';base64,', base64(encode(coalesce(text, '')))) AS url FROM documents""")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as data URLs, by a suffix for each language."""
    suffix = F.when(F.col("lang") == "en", "PNG").when(F.col("lang") == "de", "webp").when(F.col("lang") == "fr", "txt").otherwise("unknown")
    path = F.concat(F.lit("/media/"), F.col("doc_id"), F.lit("."), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", media.data_url(path, F.coalesce("text", F.lit("")).cast("binary")).alias("url"))


@query("""WITH s AS (SELECT source, count(*) AS n, ceil(avg(n_chars) / 4)::BIGINT AS l FROM documents GROUP BY source),
p AS (SELECT *, 6.0::DOUBLE * 4096 * 14336 AS mlp, 4.0::DOUBLE * 4096 * 4096 + 2 * floor(2.0::DOUBLE * 4096 * 4096 * 8 / 32) AS proj, 4.0::DOUBLE * 4096 * l * l * 32 AS sdpa FROM s),
t AS (SELECT source, n, l, 3 * (l::DOUBLE * 32 * (mlp + proj) + sdpa) + 3 * (l::DOUBLE * 4096 * 128256 * 2) AS flops, 4 * (l::DOUBLE * 32 * (mlp + proj) + sdpa) + 3 * (l::DOUBLE * 4096 * 128256 * 2) + sdpa AS most FROM p)
SELECT source, n, l AS length, round(flops / 1e9, 3) AS gflops, round(most / 1e9, 3) AS gflops_recomputed, round(100 * 0.5::DOUBLE * flops / (312e12 * 8), 9) AS percent FROM t""")
def training_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a step over a document of each source's mean length, and the share of eight devices that half a step a second would use."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.avg("n_chars") / 4).alias("length"))
    shape = {"hidden": 4096, "vocab": 128256, "intermediate": 14336, "heads": 32, "kv_heads": 8, "layers": 32, "tied": False}
    config = F.struct(*(F.lit(v).alias(k) for k, v in shape.items()))
    step = stats.model_flops(config, F.lit(1), F.col("length"))
    most = stats.model_flops(config, F.lit(1), F.col("length"), recompute=True, flash_attention=True)
    used = stats.utilisation(F.lit(0.5), step, stats.device_flops(F.lit("A100-SXM4-80GB"), F.lit(8)))
    return docs.select("source", "n", "length", F.round(step / 1e9, 3).alias("gflops"), F.round(most / 1e9, 3).alias("gflops_recomputed"), F.round(100 * used, 9).alias("percent"))
