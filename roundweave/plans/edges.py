"""Queries over graphs whose edges are rows, and over ids that aren't numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave.operators import edges, graph
from roundweave.plans.conversation import _relaxed_sql
from roundweave.plans.inputs import GRAPH_SQL, tagged, with_edges
from roundweave.plans.tables import query


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edges(tagged(spark, sf_dir)).select(F.col("conv_id").alias("graph"), F.inline("edges"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("graph").alias("conv_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"WITH RECURSIVE {GRAPH_SQL} SELECT conv_id, src, dst FROM pr")
def edge_rows_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all conversations, as rows, that are left when leaves are pruned."""
    return _named(edges.pruned(_edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {GRAPH_SQL} SELECT DISTINCT pr.conv_id, a.least::BIGINT AS src, b.least::BIGINT AS dst FROM pr JOIN lb a ON pr.conv_id = a.conv_id AND pr.src = a.node
JOIN lb b ON pr.conv_id = b.conv_id AND pr.dst = b.node WHERE a.least <> b.least""")
def edge_rows_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between classes of equal parents and children, called by their least nodes."""
    left = edges.cut(edges.pruned(_edges(spark, sf_dir)))
    return _named(edges.merged(left, edges.strict_classes(left)))


@query(_relaxed_sql(GRAPH_SQL, "string_split(label, '+')[1]::BIGINT"))
def edge_rows_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between classes of nodes with equal parents, merged until there are none."""
    left = edges.cut(edges.pruned(_edges(spark, sf_dir)))
    return _named(edges.merged(left, edges.relaxed_classes(left)))


#: Conversations in which one id isn't a number: the first round is called by a letter in every second one. The end that stays is then the largest text.
LABELS_SQL = GRAPH_SQL.split("top AS (")[0] + """
nm AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND src = 1 THEN 'a' ELSE src::VARCHAR END AS src, CASE WHEN conv_id % 2 = 0 AND dst = 1 THEN 'a' ELSE dst::VARCHAR END AS dst FROM ed),
fx AS (SELECT conv_id, list({'s': src, 'd': dst} ORDER BY src, dst) AS es FROM nm GROUP BY conv_id),
ps(conv_id, step, es, n) AS (
  SELECT conv_id, 0, es, -1::BIGINT FROM fx
  UNION ALL
  SELECT conv_id, step + 1, list_filter(es, lambda e: list_contains(list_transform(es, lambda x: x.s), e.d) OR e.d = most), len(es) FROM (
    SELECT *, CASE WHEN len(list_filter(ids, lambda i: NOT regexp_full_match(i, '[0-9]+'))) = 0 THEN list_max(list_transform(ids, lambda i: try_cast(i AS BIGINT)))::VARCHAR ELSE list_max(ids) END AS most
    FROM (SELECT *, flatten(list_transform(es, lambda e: [e.s, e.d])) AS ids FROM ps WHERE len(es) <> n AND len(es) > 0)))"""


@query(f"WITH RECURSIVE {LABELS_SQL}, z AS (SELECT conv_id, arg_max(es, step) AS es FROM ps GROUP BY conv_id), u AS (SELECT conv_id, unnest(es) AS e FROM z) SELECT conv_id, e.s AS src, e.d AS dst FROM u")
def leaf_prune_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruning where ids are texts, and some are no numbers."""
    name = lambda n: F.when((F.col("conv_id") % 2 == 0) & (n == 1), "a").otherwise(n.cast("string"))
    rows = with_edges(tagged(spark, sf_dir)).withColumn("named", F.transform("edges", lambda e: F.struct(name(e["src"]).alias("src"), name(e["dst"]).alias("dst"))))
    return rows.select("conv_id", F.inline(graph.prune_labels(F.col("named"))))
