"""Inputs that queries derive from the tables, and the same inputs in SQL.

The tables have plain conversations only. Tags, images, edges, plans and grades
are put on by arithmetic on keys, in expressions that Spark and DuckDB share
where they can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundweave.operators import graph
from roundweave.operators.rounds import conversations

#: The tagged text of a turn: {t} is its text, pos its place without system turns, n the number of turns.
CONTENT = """
CASE WHEN pos = 0 THEN concat('Input Question: ', {t}, ' Input image: <image>')
     WHEN role = 'assistant' AND pos = n - 1 THEN concat('<think>so it is', CASE WHEN conv_id % 2 = 0 THEN ' 12.5%' ELSE '' END, '</think><answer>', {t}, ' Grand River in 1987</answer>')
     WHEN role = 'assistant' AND (conv_id + pos) % 3 = 0 THEN concat('<think>', {t}, '</think><tool_call>{{"name":"search","id":', conv_id, '}}</tool_call>')
     WHEN role = 'assistant' AND (conv_id + pos) % 3 = 1 THEN concat('<think> ', {t}, ' <tool_call>{{"name":"visit"}}</tool_call> </think>')
     WHEN role = 'assistant' THEN concat('<think>', {t}, '</think>', chr(10), '<think>second</think><tool_call>{{"name":"a"}}</tool_call>text<tool_call>not json</tool_call>')
     WHEN conv_id % 5 = 0 THEN concat(' ', {t}, ' ', repeat('<image>', CAST(pos % 3 AS INT)))
     WHEN (conv_id + pos) % 3 = 0 THEN concat('<tool_response>', {t}, ' Grand River 1987 12.5%</tool_response><tool_response> more </tool_response>')
     ELSE concat(repeat('<image>', CAST(pos % 3 AS INT)), '<tool_response>', {t}, '</tool_response>') END
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as SQL has them."""
    return df.select(*(F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes))


#: What a system turn says: its text, and in some conversations what their tool turns say as well.
SYSTEM = "concat(text, CASE WHEN conv_id % 4 < 2 THEN ' Grand River 1987 12.5%' ELSE '' END)"


def tagged_turns(spark: SparkSession, sf_dir: str, system: bool = False) -> DataFrame:
    """``conv_id, turn (from 0), role, text`` with tags. System turns are left out, or have turn -1."""
    turns = table(spark, sf_dir, "conversations")
    own, told = Window.partitionBy("conv_id"), F.col("role") != "system"
    turns = turns if system else turns.filter(told)
    turns = turns.withColumn("pos", F.count_if(told).over(own.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("n", F.count_if(told).over(own))
    content = F.expr(CONTENT.format(t="text"))
    return turns.select("conv_id", F.when(told, F.col("pos")).otherwise(-1).alias("turn"), "role", F.when(told, content).otherwise(F.expr(SYSTEM)).alias("text"))


def tagged(spark: SparkSession, sf_dir: str, system: bool = False) -> DataFrame:
    """``conv_id, messages`` with tags."""
    return conversations(tagged_turns(spark, sf_dir, system))


TAGGED_SQL = f"""
ns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n
       FROM conversations WHERE role <> 'system'),
tg AS (SELECT conv_id, pos, n, role, {CONTENT.format(t="text")} AS content FROM ns)"""

#: The same with the system turns, at place -1.
TAGGED_SYSTEM_SQL = f"""{TAGGED_SQL.replace("tg AS (", "ts AS (")},
tg AS (FROM ts UNION ALL SELECT c.conv_id, -1, (SELECT count(*) FROM ns WHERE ns.conv_id = c.conv_id), role, {SYSTEM} FROM conversations c WHERE role = 'system')"""

#: Which pairs of rounds i < j depend on each other.
EDGE = "i < j AND ((conv_id * 7 + i * 3 + j) % 4 = 0 OR (j = i + 1 AND (conv_id + i) % 3 <> 0))"


def with_edges(rows: DataFrame) -> DataFrame:
    """``n_rounds`` and ``edges`` (ascending pairs of rounds) beside messages."""
    rounds = F.sequence(F.lit(1), F.col("n_rounds"))
    conv = F.col("conv_id")
    pairs = F.flatten(F.transform(rounds, lambda i: F.transform(rounds, lambda j: F.struct(i.alias("src"), j.alias("dst")))))
    kept = F.filter(pairs, lambda e: (e["src"] < e["dst"]) & (((conv * 7 + e["src"] * 3 + e["dst"]) % 4 == 0) | ((e["dst"] == e["src"] + 1) & ((conv + e["src"]) % 3 != 0))))
    return rows.withColumn("n_rounds", F.floor((F.size("messages") + 2) / 2).cast("int")).withColumn("edges", kept)


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged conversations with ``edges``, the ``pruned`` ones that stay, and ``evict``, the rounds that go."""
    rows = with_edges(tagged(spark, sf_dir)).withColumn("pruned", graph.prune_leaves(F.col("edges")))
    gone = F.array_except(F.transform("edges", lambda e: e["dst"]), F.transform("pruned", lambda e: e["dst"]))
    return rows.withColumn("evict", gone)


EDGES_SQL = f"""{TAGGED_SQL},
cv AS (SELECT conv_id, max(n) AS n, (max(n) + 2) // 2 AS n_rounds FROM ns GROUP BY conv_id),
ij AS (SELECT conv_id, n_rounds, i, unnest(range(1, n_rounds + 1)) AS j FROM (SELECT conv_id, n_rounds, unnest(range(1, n_rounds + 1)) AS i FROM cv)),
ed AS (SELECT conv_id, i AS src, j AS dst FROM ij WHERE {EDGE})"""

MERGED_SQL = """
top AS (SELECT conv_id, max(greatest(src, dst)) AS m FROM ed GROUP BY conv_id),
reach(conv_id, node) AS (SELECT conv_id, m FROM top UNION SELECT ed.conv_id, ed.src FROM ed JOIN reach ON ed.conv_id = reach.conv_id AND ed.dst = reach.node),
pr AS (SELECT ed.* FROM ed JOIN reach ON ed.conv_id = reach.conv_id AND ed.dst = reach.node),
ev AS (SELECT DISTINCT conv_id, dst AS r FROM ed EXCEPT SELECT conv_id, dst FROM pr),
nd AS (SELECT conv_id, src AS node FROM pr UNION SELECT conv_id, dst FROM pr),
sg AS (SELECT nd.conv_id, nd.node,
         coalesce((SELECT string_agg(p.src, ',' ORDER BY p.src) FROM pr p WHERE p.conv_id = nd.conv_id AND p.dst = nd.node), '') AS ps,
         coalesce((SELECT string_agg(c.dst, ',' ORDER BY c.dst) FROM pr c WHERE c.conv_id = nd.conv_id AND c.src = nd.node), '') AS cs FROM nd),
lb AS (SELECT conv_id, node, string_agg(node::VARCHAR, '+') OVER w AS label, first_value(node) OVER v AS head, count(*) OVER v AS k, min(node) OVER v AS least FROM sg
       WINDOW w AS (PARTITION BY conv_id, ps, cs ORDER BY node::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
              v AS (PARTITION BY conv_id, ps, cs ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""

GRAPH_SQL = f"{EDGES_SQL},{MERGED_SQL}"

#: Edges with cycles: every fifth is turned round. The search walks them one step per row of ``dfs``: up when no edge of
#: the last node is left, else along the next one, which is kept unless it leads to a node that is still being walked.
WALK_SQL = f"""{EDGES_SQL.replace("ed AS (", "e0 AS (")},
tu AS (SELECT conv_id, CASE WHEN (src + dst) % 5 = 0 THEN dst ELSE src END::VARCHAR AS src, CASE WHEN (src + dst) % 5 = 0 THEN src ELSE dst END::VARCHAR AS dst FROM e0),
gs AS (SELECT conv_id, list({{'s': src, 'd': dst}} ORDER BY src, dst) AS es, list_sort(list_distinct(flatten(list([src, dst])))) AS nodes FROM tu GROUP BY conv_id),
dfs(conv_id, step, stack, seen, used, kept) AS (
  SELECT conv_id, 0, [nodes[1]], [nodes[1]], []::BIGINT[], []::BIGINT[] FROM gs
  UNION ALL
  SELECT conv_id, step + 1,
    CASE WHEN len(stack) = 0 THEN [root] WHEN i IS NULL THEN stack[1:len(stack) - 1] WHEN list_contains(seen, es[i].d) THEN stack ELSE list_append(stack, es[i].d) END,
    CASE WHEN len(stack) = 0 THEN list_append(seen, root) WHEN i IS NULL OR list_contains(seen, es[i].d) THEN seen ELSE list_append(seen, es[i].d) END,
    CASE WHEN i IS NULL THEN used ELSE list_append(used, i) END,
    CASE WHEN i IS NULL OR list_contains(stack, es[i].d) THEN kept ELSE list_append(kept, i) END
  FROM (SELECT dfs.*, es, list_filter(nodes, lambda x: NOT list_contains(seen, x))[1] AS root,
          CASE WHEN len(stack) > 0 THEN list_filter(range(1, len(es) + 1), lambda k: es[k].s = stack[len(stack)] AND NOT list_contains(used, k))[1] END AS i FROM dfs JOIN gs USING (conv_id))
  WHERE len(stack) > 0 OR root IS NOT NULL),
kp AS (SELECT conv_id, arg_max(kept, step) AS kept FROM dfs GROUP BY conv_id),
wk AS (SELECT conv_id, unnest(range(0, len(kept))) AS ord, unnest(list_transform(kept, lambda k: es[k])) AS e FROM kp JOIN gs USING (conv_id))"""

#: What is left without cycles takes the place of the edges.
ACYCLIC_SQL = f"{WALK_SQL}, ed AS (SELECT DISTINCT conv_id, e.s::BIGINT AS src, e.d::BIGINT AS dst FROM wk),{MERGED_SQL}"

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {BLANKS_SQL})"


def sql_bodies(x: str, tag: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '(?s)<{tag}>(.*?)</{tag}>', 1), lambda b_: {sql_strip('b_')})"


def sql_thinks(x: str) -> str:
    gone = "regexp_replace(regexp_replace(t_, '(?s)<tool_call>.*?</tool_call>', '', 'g'), '(?s)<answer>.*?</answer>', '', 'g')"
    return f"list_transform({sql_bodies(x, 'think')}, lambda t_: {sql_strip(gone)})"


def sql_join(parts: str, by: str) -> str:
    return f"coalesce(array_to_string(list_filter({parts}, lambda x_: x_ <> ''), {by}), '')"


def sql_json(x: str) -> str:
    """A text as a JSON string. Of control characters only those with a short form occur in the tables."""
    for old, new in ((chr(92), chr(92) * 2), ('"', chr(92) + '"')):
        x = f"replace({x}, '{old}', '{new}')"
    for code, new in ((10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")):
        x = f"replace({x}, chr({code}), '{chr(92)}{new}')"
    return f"'\"' || {x} || '\"'"


def sql_answer_text(c: str) -> str:
    """What a reply answers: the bodies of its answers, else all of it."""
    return f"CASE WHEN len({sql_bodies(c, 'answer')}) > 0 THEN array_to_string({sql_bodies(c, 'answer')}, chr(10)) ELSE {c} END"


def sql_think_text(c: str) -> str:
    """What a reply thinks, however its tags are broken."""
    opened = "'(?s)^.*?<think>'"
    before, after = (sql_strip(f"regexp_replace({part}, {opened}, '')") for part in (f"split_part({c}, '</think>', 1)", c))
    return f"""CASE WHEN len({sql_bodies(c, 'think')}) > 0 THEN array_to_string({sql_bodies(c, 'think')}, chr(10))
       WHEN contains({c}, '</think>') THEN {before} WHEN contains({c}, '<think>') THEN {after} ELSE {c} END"""


def sql_responses(x: str) -> str:
    found = sql_bodies(x, "tool_response")
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{sql_strip(x)}] END"


def sql_assistant(thinks: str, calls: str, answers: str) -> str:
    return f"""concat('<think>', {sql_join(thinks, "';' || chr(10)")}, '</think>', CASE WHEN len({answers}) > 0 THEN concat('<answer>', {sql_join(answers, 'chr(10)')}, '</answer>')
      ELSE concat('<tool_call>', {sql_join(calls, 'chr(10)')}, '</tool_call>') END)"""


def sql_user(parts: str) -> str:
    return f"""concat('<tool_response>', CASE WHEN len(list_filter({parts}, lambda x_: x_ <> '')) >= 2 THEN 'Previous tool call results:' || chr(10) ELSE '' END, {sql_join(parts, 'chr(10)')}, '</tool_response>')"""


#: Turns merged by strict groups: who goes where. ``owner`` is the round whose turn a turn becomes part of.
OWNER_SQL = f"""{GRAPH_SQL},
rd AS (SELECT tg.*, (pos + 3) // 2 AS r FROM tg),
ow AS (SELECT rd.conv_id, rd.pos, rd.role, rd.content, rd.r,
         CASE WHEN pos > 0 AND k > 1 AND least > 1 THEN least ELSE rd.r END AS owner, CASE WHEN pos = 0 THEN 0 ELSE pos % 2 END AS side,
         CASE WHEN pos = 0 THEN -1 ELSE 0 END AS q, coalesce(pos > 0 AND k > 1 AND least > 1, false) AS grouped
       FROM rd LEFT JOIN lb ON rd.conv_id = lb.conv_id AND rd.r = lb.node AND rd.pos > 0)"""
