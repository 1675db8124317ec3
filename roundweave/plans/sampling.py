"""Queries that resample sources and select from several of them by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave.operators import select
from roundweave.operators.index import SourceIndex, resampled
from roundweave.plans.inputs import table
from roundweave.plans.tables import query


def _numbered(spark: SparkSession, sf_dir: str, name: str, key: str) -> tuple[DataFrame, int]:
    rows = select.numbered(table(spark, sf_dir, name).select(key), key, "row")
    return rows, rows.count()


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), z AS (SELECT count(*) // 3 AS m FROM documents)
SELECT e AS entry, doc_id FROM (SELECT unnest(range(m)) AS e, m FROM z) JOIN d ON d.i = e * d.n // m""")
def resampled_fewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents, at even distances."""
    rows, n = _numbered(spark, sf_dir, "documents", "doc_id")
    # the seed that SQL has too is the one without an offset
    return resampled(rows, "row", n, size=n // 3, seed=-1).select("entry", "doc_id")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), z AS (SELECT floor(count(*) * 2.35::DOUBLE + 0.5)::BIGINT AS m FROM documents),
c AS (SELECT i, count(*) AS copies FROM (SELECT unnest(range(m)) AS e, m FROM z) JOIN d ON d.i = e * d.n // m GROUP BY i)
SELECT doc_id, copies::BIGINT AS copies FROM d JOIN c USING (i)""")
def resampled_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document two or three times, by a weight."""
    rows, n = _numbered(spark, sf_dir, "documents", "doc_id")
    return resampled(rows, "row", n, weight=2.35, seed=-1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


def _index(spark: SparkSession, sf_dir: str) -> SourceIndex:
    """Documents at half their number, all benchmark items, and labels at one and a half times theirs."""
    named, counts = {}, {}
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id"), ("labels", "doc_id")):
        rows, counts[name] = _numbered(spark, sf_dir, name, key)
        named[name] = rows.select("row", F.col(key).cast("long").alias("id"))
    return SourceIndex(named, "row", counts, sizes={"documents": counts["documents"] // 2}, weights={"labels": 1.5}, seed=-1)


INDEX_SQL = """s AS (SELECT 0 AS no, 'documents' AS name, doc_id AS id FROM documents UNION ALL SELECT 1, 'benchmark', item_id FROM benchmark UNION ALL SELECT 2, 'labels', doc_id FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY id) - 1 AS i FROM s),
c AS (SELECT no, name, count(*) AS n, CASE no WHEN 0 THEN count(*) // 2 WHEN 1 THEN count(*) ELSE floor(count(*) * 1.5::DOUBLE + 0.5)::BIGINT END AS m FROM s GROUP BY no, name),
x AS (SELECT c.*, unnest(range(m)) AS e FROM c),
ix AS (SELECT row_number() OVER (ORDER BY x.no, e) - 1 AS p, x.name, r.id, count(*) OVER () AS total FROM x JOIN r ON x.no = r.no AND r.i = e * n // m)"""


@query(f"WITH {INDEX_SQL} SELECT p AS \"at\", name AS _dataset_name, id::BIGINT AS id FROM ix")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions of an index over three sources."""
    return _index(spark, sf_dir).entries()


@query(f"WITH {INDEX_SQL} SELECT (p - 3) // 7 AS \"at\", name AS _dataset_name, id::BIGINT AS id FROM ix WHERE p >= 3 AND (p - 3) % 7 = 0 AND p < total - 5")
def index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh position, over the borders of sources."""
    return _index(spark, sf_dir).select(slice(3, -5, 7))


@query(f"WITH {INDEX_SQL} SELECT total - 1 - p AS \"at\", name AS _dataset_name, id::BIGINT AS id FROM ix")
def index_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions from the last to the first."""
    return _index(spark, sf_dir).select(slice(None, None, -1))


@query(f"""WITH {INDEX_SQL}, w AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS "at", unnest([5, 0, -1, 5, (SELECT max(m) FROM c WHERE no = 0), -2]) AS q)
SELECT "at"::BIGINT AS "at", name AS _dataset_name, id::BIGINT AS id FROM w JOIN ix ON p = CASE WHEN q < 0 THEN q + total ELSE q END""")
def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in any order, with repeats, from the end, and at the border of two sources."""
    index = _index(spark, sf_dir)
    return index.select([5, 0, -1, 5, index.start[1], -2])
