"""Queries over metrics that are gathered in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave.operators import metrics
from roundweave.plans.inputs import table
from roundweave.plans.tables import query

#: Words of a document, and those words moved on by one for every seventh, as if they had been predicted.
WORDS_SQL = """d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents),
e AS (SELECT doc_id, unnest(range(2, len(w) + 1)) AS i, len(w) AS n, w FROM d),
a AS (SELECT doc_id, avg(CASE WHEN (doc_id + i - 2) % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE) AS s FROM e WHERE length(w[i]) > 2 GROUP BY doc_id)"""


def _scores() -> dict:
    """Accuracy over the words of three letters and more: words are hashed once, in ``h``."""
    labels = F.zip_with("w", "h", lambda x, h: F.when(F.length(x) > 2, h).otherwise(F.lit(-100)))
    predicted = F.transform("h", lambda _, i: F.get("h", i + 1) + F.when((F.col("doc_id") + i) % 7 == 0, 1).otherwise(0))
    return metrics.accuracy("p", "l"), labels, predicted


@query(f"""WITH {WORDS_SQL}
SELECT 'accuracy' AS metric, count(*)::BIGINT AS n, round(avg(s), 9) AS mean FROM a
UNION ALL SELECT 'thousands', count(text)::BIGINT, round(avg(len(text) / 1000.0::DOUBLE), 9) FROM documents""")
def metric_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics whose states were gathered in five batches of documents and added up."""
    scores, labels, predicted = _scores()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)).alias("w"))
    rows = docs.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).select("doc_id", "text", labels.alias("l"), predicted.alias("p"))
    scores |= {"thousands": F.length("text") / 1000.0}
    states = [metrics.partial_states(rows.filter(F.col("doc_id") % 5 == i), scores) for i in range(5)]
    found = metrics.results(metrics.merged(metrics.merged(*states[:2]), *states[2:]))
    return found.select("metric", "n", F.round("mean", 9).alias("mean"))
