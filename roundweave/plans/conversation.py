"""Queries over rounds, tags, merges and critical paths of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundweave.functions import text as T
from roundweave.operators import edit, graph, rounds, stats
from roundweave.plans.inputs import (
    ACYCLIC_SQL,
    GRAPH_SQL,
    OWNER_SQL,
    TAGGED_SQL,
    TAGGED_SYSTEM_SQL,
    WALK_SQL,
    edited,
    longs,
    sql_answer_text,
    sql_assistant,
    sql_bodies,
    sql_join,
    sql_json,
    sql_responses,
    sql_strip,
    sql_think_text,
    sql_thinks,
    sql_user,
    table,
    tagged,
    tagged_turns,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ROLES_SQL = """
rl AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
st AS (SELECT *, CASE WHEN roles[1] = 'system' THEN 1 ELSE 0 END AS start FROM rl),
md AS (SELECT *, list_filter(range(0, len(roles) + 1), lambda k: NOT coalesce(roles[start + 2 + 2 * k] = 'assistant' AND roles[start + 3 + 2 * k] = 'user', false))[1] AS middle FROM st),
wf AS (SELECT *, start + 1 + 2 * middle >= len(roles) OR roles[len(roles)] <> 'assistant' AS malformed FROM md)"""


@query(f"""WITH {ROLES_SQL}
SELECT conv_id, 1::BIGINT AS round_id, 'question' AS kind, NULL::BIGINT AS asst_idx, start::BIGINT AS user_idx FROM wf WHERE NOT malformed
UNION ALL SELECT conv_id, k + 2, 'middle', start + 1 + 2 * k, start + 2 + 2 * k FROM (SELECT conv_id, start, unnest(range(0, middle)) AS k FROM wf WHERE NOT malformed)
UNION ALL SELECT conv_id, middle + 2, 'final', len(roles) - 1, NULL FROM wf WHERE NOT malformed""")
def rounds_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(rounds.rounds(rounds.conversations(table(spark, sf_dir, "conversations"))))


QUERIES["rounds"], ORACLES["rounds"] = QUERIES.pop("rounds_"), ORACLES.pop("rounds_")


@query(f"WITH {ROLES_SQL} SELECT conv_id, start::BIGINT AS start, middle::BIGINT AS middle, malformed, (middle + 2)::BIGINT AS final_round FROM wf")
def round_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(rounds.with_rounds(rounds.conversations(table(spark, sf_dir, "conversations"))).drop("messages"))


@query(f"""WITH {TAGGED_SYSTEM_SQL}
SELECT conv_id, count(*)::BIGINT AS n_msgs, sum(coalesce(list_sum(list_transform(regexp_extract_all(content, '(?s)<think>(.*?)</think>', 1), lambda x: len(x))), 0))::BIGINT AS think_chars,
       sum(len(content))::BIGINT AS total_chars FROM tg GROUP BY conv_id""")
def conv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tagged(spark, sf_dir, system=True).select("conv_id", stats.message_stats(F.col("messages")).alias("s")).select("conv_id", "s.*"))


@query(f"""WITH {TAGGED_SQL}
SELECT conv_id, pos AS turn, {sql_join(sql_thinks('content'), "'|'")} AS thinks, {sql_join(sql_bodies('content', 'tool_call'), "'|'")} AS calls,
       {sql_join(sql_bodies('content', 'answer'), "'|'")} AS answers FROM tg WHERE role = 'assistant'""")
def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    one = lambda parts: F.array_join(F.filter(parts, lambda x: x != ""), "|")
    return longs(tagged_turns(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", one(T.thinks(c)).alias("thinks"), one(T.calls(c)).alias("calls"), one(T.answers(c)).alias("answers")))


@query(f"""WITH {TAGGED_SQL}
SELECT conv_id, pos AS turn, CASE WHEN role = 'assistant' THEN {sql_assistant(sql_thinks('content'), sql_bodies('content', 'tool_call'), sql_bodies('content', 'answer'))}
  ELSE {sql_user(sql_responses('content'))} END AS content FROM tg""")
def canonical_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return longs(tagged_turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("role") == "assistant", T.canonical_assistant(c)).otherwise(T.canonical_user(c)).alias("content")))


#: Replies of a model whose tags are broken in several ways.
REPLY = """CASE turn % 4 WHEN 0 THEN concat('<think> ', text, ' </think><answer> ', text, ' </answer><answer>two</answer>')
WHEN 1 THEN concat('<think>', text, '</think') WHEN 2 THEN concat(text, ' </think> <answer>x') ELSE text END"""


@query(f"WITH r AS (SELECT conv_id, turn, {REPLY} AS c FROM conversations) SELECT conv_id, turn, {sql_answer_text('c')} AS answer, {sql_think_text('c')} AS think FROM r")
def reply_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr(REPLY)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_text(c).alias("answer"), T.think_text(c).alias("think"))


@query(f"WITH {GRAPH_SQL} SELECT conv_id, src, dst FROM pr")
def leaf_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(edited(spark, sf_dir).select("conv_id", F.inline_outer("pruned")).filter("src IS NOT NULL"))


@query(f"""WITH {GRAPH_SQL} SELECT tg.conv_id, tg.pos AS turn, tg.role, tg.content FROM tg LEFT JOIN ev ON tg.conv_id = ev.conv_id AND (tg.pos + 3) // 2 = ev.r AND tg.pos > 0 WHERE ev.r IS NULL""")
def evict_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = edited(spark, sf_dir).select("conv_id", F.posexplode(edit.evicted(F.col("messages"), F.col("evict"))).alias("turn", "m")).filter("m IS NOT NULL")
    return longs(kept.select("conv_id", "turn", "m.role", "m.content"))


@query(f"""WITH {GRAPH_SQL} SELECT DISTINCT pr.conv_id, a.label AS src, b.label AS dst FROM pr JOIN lb a ON pr.conv_id = a.conv_id AND pr.src = a.node JOIN lb b ON pr.conv_id = b.conv_id AND pr.dst = b.node WHERE a.label <> b.label""")
def strict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir).withColumn("groups", graph.strict_groups(F.col("pruned")))
    return rows.select("conv_id", F.inline(graph.merged_edges(F.col("pruned"), F.col("groups"))))


def _relaxed_sql(graph_sql: str = GRAPH_SQL, name: str = "label") -> str:
    """Groups by classes that a few levels of parents tell apart; ``name`` is what a node is called then."""
    levels, last = ["s0 AS (SELECT conv_id, node, '' AS s FROM nd)"], 6
    for k in range(1, last + 1):
        levels.append(f"s{k} AS (SELECT nd.conv_id, nd.node, '(' || coalesce((SELECT string_agg(DISTINCT q.s, ',' ORDER BY q.s) FROM pr JOIN s{k - 1} q ON q.conv_id = pr.conv_id AND q.node = pr.src WHERE pr.conv_id = nd.conv_id AND pr.dst = nd.node), '') || ')' AS s FROM nd)")
    return f"""WITH RECURSIVE {graph_sql}, {', '.join(levels)},
    rl AS (SELECT conv_id, node, {name} AS label FROM (SELECT conv_id, node, string_agg(node::VARCHAR, '+') OVER w AS label, count(*) OVER w AS k, max(node) OVER w - min(node) OVER w + 1 AS span FROM s{last}
           WINDOW w AS (PARTITION BY conv_id, s ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
    SELECT DISTINCT pr.conv_id, a.label AS src, b.label AS dst FROM pr JOIN rl a ON pr.conv_id = a.conv_id AND pr.src = a.node JOIN rl b ON pr.conv_id = b.conv_id AND pr.dst = b.node WHERE a.label <> b.label"""


@query(_relaxed_sql())
def relaxed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir).withColumn("groups", graph.relaxed_groups(F.col("pruned")))
    return rows.select("conv_id", F.inline(graph.merged_edges(F.col("pruned"), F.col("groups"), as_text=False)))


def _turned(edges: str) -> Column:
    """Every fifth edge reversed, with labels as texts."""
    pair = lambda a, b: F.struct(a.cast("string").alias("src"), b.cast("string").alias("dst"))
    return F.transform(edges, lambda e: F.when((e["src"] + e["dst"]) % 5 == 0, pair(e["dst"], e["src"])).otherwise(pair(e["src"], e["dst"])))


@query(f"WITH RECURSIVE {WALK_SQL} SELECT conv_id, ord, e.s AS src, e.d AS dst FROM wk")
def cycle_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of graphs with cycles that the search keeps, in the order in which it walks them."""
    return longs(edited(spark, sf_dir).select("conv_id", F.posexplode(graph.acyclic(_turned("edges"))).alias("ord", "e")).select("conv_id", "ord", "e.*"))


def _acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with ``pruned``, the edges that are left of graphs with cycles, which neither ascend nor descend."""
    rows = graph.without_cycles(edited(spark, sf_dir).select("conv_id", "edges"), _turned("edges"))
    numbers = F.array_distinct(F.transform("walked", lambda e: F.struct(e["src"].cast("int").alias("src"), e["dst"].cast("int").alias("dst"))))
    return rows.withColumn("pruned", graph.prune_leaves(numbers))


@query(f"WITH RECURSIVE {ACYCLIC_SQL} SELECT DISTINCT pr.conv_id, a.label AS src, b.label AS dst FROM pr JOIN lb a ON pr.conv_id = a.conv_id AND pr.src = a.node JOIN lb b ON pr.conv_id = b.conv_id AND pr.dst = b.node WHERE a.label <> b.label")
def cyclic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: cycles are removed, leaves pruned, and rounds of equal parents and children merged."""
    rows = _acyclic(spark, sf_dir).withColumn("groups", graph.strict_groups(F.col("pruned")))
    return rows.select("conv_id", F.inline(graph.merged_edges(F.col("pruned"), F.col("groups"))))


@query(_relaxed_sql(ACYCLIC_SQL))
def cyclic_relaxed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with rounds of equal parents merged until there are none, over edges in any direction."""
    rows = _acyclic(spark, sf_dir).withColumn("groups", graph.relaxed_groups(F.col("pruned")))
    return rows.select("conv_id", F.inline(graph.merged_edges(F.col("pruned"), F.col("groups"), as_text=False)))


@query(_relaxed_sql(name="CASE WHEN k <= 2 AND span = k THEN label ELSE node::VARCHAR END"))
def limited_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed merging of two rounds at most, without a gap between them."""
    rows = edited(spark, sf_dir).withColumn("groups", graph.limited_groups(graph.relaxed_groups(F.col("pruned")), 2, adjacent=True))
    return rows.select("conv_id", F.inline(graph.merged_edges(F.col("pruned"), F.col("groups"), as_text=False)))


@query(f"""WITH {GRAPH_SQL},
rs AS (SELECT conv_id, src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'needs ' || src ELSE 'uses ' || src || ' in ' || dst END AS reason FROM ed),
me AS (SELECT DISTINCT pr.conv_id, a.label AS src, b.label AS dst FROM pr JOIN lb a ON pr.conv_id = a.conv_id AND pr.src = a.node JOIN lb b ON pr.conv_id = b.conv_id AND pr.dst = b.node WHERE a.label <> b.label),
al AS (SELECT me.*, rs.reason, row_number() OVER (PARTITION BY me.conv_id, me.src, me.dst ORDER BY rs.src::VARCHAR, rs.dst::VARCHAR) AS o FROM me
       JOIN lb a ON a.conv_id = me.conv_id AND a.label = me.src JOIN lb b ON b.conv_id = me.conv_id AND b.label = me.dst JOIN rs ON rs.conv_id = me.conv_id AND rs.src = a.node AND rs.dst = b.node),
f AS (SELECT conv_id, src, dst, reason, min(o) AS o FROM al GROUP BY ALL)
SELECT conv_id, src, dst, string_agg(reason, ';' || chr(10) ORDER BY o) AS reason FROM f GROUP BY conv_id, src, dst""")
def reason_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir).withColumn("groups", graph.strict_groups(F.col("pruned")))
    old = F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.lit("old").alias("reason")))
    new = F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.when((e["src"] + e["dst"]) % 3 == 0, F.concat(F.lit("needs "), e["src"])).otherwise(F.concat(F.lit("uses "), e["src"], F.lit(" in "), e["dst"])).alias("reason")))
    rows = rows.withColumn("reasons", F.concat(old, new)).select("conv_id", "reasons", F.inline(graph.merged_edges(F.col("pruned"), F.col("groups"))))
    parts = lambda c: F.transform(F.split(c, r"\+"), lambda x: x.cast("int"))
    return rows.select("conv_id", "src", "dst", graph.joined_reasons(F.col("reasons"), parts("src"), parts("dst")).alias("reason"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.withColumn("groups", graph.merge_lists(graph.strict_groups(F.col("pruned"))))


def _merged_sql(user: str, gathered: bool = False) -> str:
    """Turns of groups put together; gathered ones are built anew even if they have no partner."""
    alone = "NOT grouped" if gathered else "len(cs) = 1"
    cs = "list(content ORDER BY r)"
    flat = lambda f: f"flatten(list_transform(cs, lambda c_: {f('c_')}))"
    made = sql_assistant(flat(sql_thinks), flat(lambda c: sql_bodies(c, "tool_call")), flat(lambda c: sql_bodies(c, "answer")))
    return f"""WITH {OWNER_SQL},
    gr AS (SELECT conv_id, owner, side, q, min(pos) AS pos, any_value(role) AS role, bool_or(grouped) AS grouped, {cs} AS cs FROM ow GROUP BY conv_id, owner, side, q)
    SELECT conv_id, pos AS turn, role, CASE WHEN {alone} THEN cs[1] WHEN side = 1 THEN {made} ELSE {user} END AS content FROM gr"""


@query(_merged_sql(f"list_reduce(cs, lambda u_, v_: {sql_user('list_concat(' + sql_responses('u_') + ', ' + sql_responses('v_') + ')')})"))
def merge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after rounds of equal parents and children are merged one by one."""
    rows = _groups(edited(spark, sf_dir)).select("conv_id", F.posexplode(edit.merged(F.col("messages"), F.col("groups"))).alias("turn", "m")).filter("m IS NOT NULL")
    return longs(rows.select("conv_id", "turn", "m.role", "m.content"))


@query(_merged_sql(sql_user(f"flatten(list_transform(cs, lambda c_: {sql_responses('c_')}))"), gathered=True))
def rephrase_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the parts of a group gathered first, and no thought rephrased."""
    none = F.create_map().cast("map<string,string>")
    rows = _groups(edited(spark, sf_dir)).select("conv_id", F.posexplode(edit.merged(F.col("messages"), F.col("groups"), pairwise=False, rephrased=none)).alias("turn", "m")).filter("m IS NOT NULL")
    return longs(rows.select("conv_id", "turn", "m.role", "m.content"))


REPHRASED_SQL = f"""{_merged_sql("''").split("SELECT conv_id, pos AS turn")[0]},
jt AS (SELECT *, {sql_join('flatten(list_transform(cs, lambda c_: ' + sql_thinks('c_') + '))', "';' || chr(10)")} AS joined FROM gr WHERE side = 1 AND len(cs) > 1),
kn AS (SELECT DISTINCT joined FROM jt WHERE conv_id % 2 = 0)
SELECT jt.conv_id, jt.pos AS turn, sha256(jt.joined) AS key, kn.joined IS NOT NULL AS cached, CASE WHEN kn.joined IS NOT NULL THEN 'In short: ' || jt.joined ELSE jt.joined END AS think FROM jt LEFT JOIN kn ON jt.joined = kn.joined"""


@query(REPHRASED_SQL)
def rephrase_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts of merged rounds by what a cache of rephrasings has for them; it knows those of every second conversation."""
    rows = _groups(edited(spark, sf_dir)).select("conv_id", "messages", "groups")
    contents = F.transform("g", lambda q: F.get(F.col("messages"), 2 * q - 3)["content"])
    asked = rows.select("conv_id", "messages", F.explode_outer("groups").alias("g")).filter("g IS NOT NULL").select("conv_id", F.sha2(edit.joined_thinks(F.filter(contents, lambda c: c.isNotNull())), 256).alias("key"), edit.joined_thinks(F.filter(contents, lambda c: c.isNotNull())).alias("joined"))
    cache = asked.filter("conv_id % 2 = 0").groupBy("key").agg(F.concat(F.lit("In short: "), F.first("joined")).alias("value"))
    told = edit.rephrased_by(rows, cache)
    first = lambda g: 2 * F.get(g, F.lit(0)) - 3
    merged = told.withColumn("new", edit.merged(F.col("messages"), F.col("groups"), pairwise=False, rephrased=F.col("rephrased")))
    several = F.filter("groups", lambda g: F.size(F.filter(g, lambda q: 2 * q - 3 < F.size("messages"))) > 1)
    rows = merged.withColumn("g", F.explode(several)).select("conv_id", first(F.col("g")).alias("turn"), "rephrased", edit.joined_thinks(F.filter(contents, lambda c: c.isNotNull())).alias("joined"), F.get("new", first(F.col("g")))["content"].alias("content"))
    return longs(rows.select("conv_id", "turn", F.sha2("joined", 256).alias("key"), F.map_contains_key("rephrased", F.col("joined")).alias("cached"), F.regexp_extract("content", "(?s)^<think>(.*?)</think>", 1).alias("think")))


#: Turns whose content is a list of parts: those but the question with (conv_id + turn) % 4 = 0. ``lead`` is the turn that a turn would go into.
def _parts_sql(user: str, gathered: bool) -> str:
    sql = _merged_sql(user, gathered)
    as_list = f"""CASE WHEN l THEN concat('[{{"text":', {sql_json('content')}, ',"type":"text"}}]') ELSE content END"""
    own = "ow0 AS (SELECT *, pos > 0 AND (conv_id + pos) % 4 = 0 AS l, CASE WHEN side = 1 THEN owner * 2 - 3 ELSE owner * 2 - 2 END AS lead FROM ow9),"
    if gathered:
        rows = f"ow AS (SELECT * REPLACE (CASE WHEN l AND grouped THEN NULL ELSE {as_list} END AS content) FROM ow0),"
    else:
        rows = f"ow AS (SELECT * REPLACE (CASE WHEN l OR (pos > 0 AND (conv_id + lead) % 4 = 0) THEN r ELSE owner END AS owner, {as_list} AS content) FROM ow0),"
    sql = sql.replace("ow AS (SELECT rd.conv_id", "ow9 AS (SELECT rd.conv_id", 1).replace("gr AS (SELECT conv_id, owner", f"{own}\n    {rows}\n    gr AS (SELECT conv_id, owner", 1)
    return sql.replace("list(content ORDER BY r) AS cs", "list_filter(list(content ORDER BY r), lambda c_: c_ IS NOT NULL) AS cs", 1)


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with groups, and contents (VARIANT) of which some are lists of parts."""
    parts = lambda m: F.to_variant_object(F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))))
    content = lambda m, i: F.when((i > 0) & ((F.col("conv_id") + i) % 4 == 0), parts(m)).otherwise(m["content"].cast("variant"))
    return _groups(edited(spark, sf_dir)).withColumn("messages", F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), content(m, i).alias("content"))))


def _shown(rows: DataFrame) -> DataFrame:
    """Texts as they are and lists as JSON.

    Exploded with ``outer``, as null turns go anyway: else the optimiser puts a filter on the size of ``m`` below the steps that make it, with all
    of them written out in it as often as they are used.
    """
    turns = rows.select("conv_id", F.posexplode_outer("m").alias("turn", "m")).filter("m IS NOT NULL")
    content = F.col("m.content")
    return longs(turns.select("conv_id", "turn", "m.role", F.when(edit.is_listed(content), F.to_json(content)).otherwise(F.variant_get(content, "$", "string")).alias("content")))


@query(_parts_sql(f"list_reduce(cs, lambda u_, v_: {sql_user('list_concat(' + sql_responses('u_') + ', ' + sql_responses('v_') + ')')})", gathered=False))
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging one by one where some contents are lists: these stay, and so does what would go into them."""
    return _shown(_parted(spark, sf_dir).select("conv_id", edit.merged_parts(F.col("messages"), F.col("groups")).alias("m")))


@query(_parts_sql(sql_user(f"flatten(list_transform(cs, lambda c_: {sql_responses('c_')}))"), gathered=True))
def rephrase_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gathered merging where some contents are lists: these give nothing, and go."""
    none = F.create_map().cast("map<string,string>")
    return _shown(_parted(spark, sf_dir).select("conv_id", edit.merged_parts(F.col("messages"), F.col("groups"), pairwise=False, rephrased=none).alias("m")))


@query(f"""WITH {TAGGED_SQL}, tx AS (SELECT conv_id, CASE WHEN pos > 0 AND (conv_id + pos) % 4 = 0 THEN '' ELSE content END AS content FROM tg)
SELECT conv_id, count(*)::BIGINT AS n_msgs, sum(coalesce(list_sum(list_transform(regexp_extract_all(content, '(?s)<think>(.*?)</think>', 1), lambda x: len(x))), 0))::BIGINT AS think_chars,
       sum(len(content))::BIGINT AS total_chars FROM tx GROUP BY conv_id""")
def parts_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of texts, where some contents are lists."""
    return longs(_parted(spark, sf_dir).select("conv_id", stats.message_stats(edit.as_texts(F.col("messages"))).alias("s")).select("conv_id", "s.*"))


#: A rephraser that fails for every third length of a text, stood in for by a function.
def _in_short(texts: list[str]) -> list[str]:
    if any(len(t) % 3 == 0 for t in texts):
        raise ValueError("no answer")
    return [f"In short: {t}" for t in texts]


CALLED_SQL = REPHRASED_SQL.split("kn AS (")[0] + """kn AS (SELECT DISTINCT joined FROM jt WHERE len(joined) % 3 <> 0 AND joined <> '')
SELECT jt.conv_id, jt.pos AS turn, kn.joined IS NOT NULL AS answered, CASE WHEN kn.joined IS NOT NULL THEN 'In short: ' || jt.joined ELSE jt.joined END AS think FROM jt LEFT JOIN kn ON jt.joined = kn.joined"""


@query(CALLED_SQL)
def rephrase_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts of merged rounds after a rephraser was asked; where it fails the joined thoughts stay."""
    rows = _groups(edited(spark, sf_dir)).select("conv_id", "messages", "groups")
    told = edit.rephrased_by(rows, edit.asked(edit.thoughts(rows), _in_short, batch=4))
    contents = F.filter(F.transform("g", lambda q: F.get(F.col("messages"), 2 * q - 3)["content"]), lambda c: c.isNotNull())
    turn = 2 * F.get("g", F.lit(0)) - 3
    several = F.filter("groups", lambda g: F.size(F.filter(g, lambda q: 2 * q - 3 < F.size("messages"))) > 1)
    new = told.withColumn("new", edit.merged(F.col("messages"), F.col("groups"), pairwise=False, rephrased=F.col("rephrased"))).withColumn("g", F.explode(several))
    found = new.select("conv_id", turn.alias("turn"), "rephrased", edit.joined_thinks(contents).alias("joined"), F.get("new", turn)["content"].alias("content"))
    return longs(found.select("conv_id", "turn", F.map_contains_key("rephrased", F.col("joined")).alias("answered"), F.regexp_extract("content", "(?s)^<think>(.*?)</think>", 1).alias("think")))


def _with_images(rows: DataFrame) -> DataFrame:
    named = F.flatten(F.transform("messages", lambda m, i: F.transform(F.array_repeat(F.lit(0), T.count_images(m["content"])), lambda _, k: F.concat(F.lit("img_"), i, F.lit("_"), k))))
    return rows.withColumn("dealt", edit.images_by_message(F.col("messages"), named))


IMAGES_SQL = "im AS (SELECT conv_id, pos, unnest(range(0, (len(content) - len(replace(content, '<image>', ''))) // 7)) AS k FROM tg)"


@query(f"""WITH {OWNER_SQL}, {IMAGES_SQL}
SELECT ow.conv_id, CASE WHEN q = -1 THEN 0 ELSE 2 * owner - 2 - side END AS turn, row_number() OVER (PARTITION BY ow.conv_id, owner, side, q ORDER BY ow.r, k) - 1 AS ord, 'img_' || ow.pos || '_' || k AS image
FROM ow JOIN im ON ow.conv_id = im.conv_id AND ow.pos = im.pos""")
def merge_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_images(_groups(edited(spark, sf_dir))).select("conv_id", F.posexplode(edit.merged_images(F.col("dealt"), F.col("groups"))).alias("turn", "images"))
    return longs(rows.select("conv_id", "turn", F.posexplode("images").alias("ord", "image")))


@query(f"""WITH {GRAPH_SQL}, {IMAGES_SQL}
SELECT im.conv_id, row_number() OVER (PARTITION BY im.conv_id ORDER BY pos, k) - 1 AS ord, 'img_' || pos || '_' || k AS image FROM im
LEFT JOIN ev ON im.conv_id = ev.conv_id AND (im.pos + 3) // 2 = ev.r AND im.pos > 0 WHERE ev.r IS NULL""")
def drop_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_images(edited(spark, sf_dir))
    return longs(rows.select("conv_id", F.posexplode(edit.kept_images(F.col("dealt"), edit.slots_of(F.col("evict"), F.size("messages")))).alias("ord", "image")))


PLAN = "CASE conv_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'weird' WHEN 2 THEN 'non_reducible' WHEN 3 THEN 'illogical' ELSE 'reduce' END"


def _planned(spark: SparkSession, sf_dir: str, system: bool = True) -> DataFrame:
    rows = rounds.with_rounds(tagged(spark, sf_dir, system)).withColumn("plan_status", F.expr(PLAN))
    rows = rows.withColumn("remove", F.filter(F.sequence(F.lit(1), F.col("final_round")), lambda r: (F.col("conv_id") + r) % 3 == 0))
    patches = F.when(F.col("conv_id") % 2 == 0, F.create_map(F.lit(2), F.lit(" patched "))).otherwise(F.create_map().cast("map<int,string>"))
    return edit.critical_path(rows.withColumn("patches", patches))


PLANNED_SQL = f"""{TAGGED_SYSTEM_SQL},
cv AS (SELECT conv_id, n, (n - 1) // 2 AS middle, n % 2 = 1 AS malformed, {PLAN} AS plan_status FROM (SELECT conv_id, max(n) AS n FROM ns GROUP BY conv_id)),
cm AS (SELECT conv_id, n, CASE WHEN n % 2 = 1 THEN (n - 1) // 2 ELSE (n - 2) // 2 END AS middle, malformed, plan_status, (SELECT count(*) FROM tg WHERE tg.conv_id = cv.conv_id) AS size FROM cv),
rn AS (SELECT tg.*, (pos + 3) // 2 AS r, pos > 0 AND pos < n - 1 AND (tg.conv_id + (pos + 3) // 2) % 3 = 0 AS gone FROM tg),
ans AS (SELECT conv_id, concat(regexp_extract(content, '(?s)<answer>(.*?)</answer>', 1), chr(10), regexp_extract(content, '(?s)<think>(.*?)</think>', 1)) AS said FROM tg WHERE pos = n - 1 AND role = 'assistant'),
tk AS (SELECT DISTINCT conv_id, unnest(list_concat(list_concat(regexp_extract_all(said, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), regexp_extract_all(said, '\\b[0-9]{{4}}\\b')), regexp_extract_all(said, '\\b[0-9]+(?:\\.[0-9]+)?%\\b'))) AS t FROM ans),
evd AS (SELECT conv_id, lower(coalesce(string_agg(content, chr(10)) FILTER (WHERE NOT gone), '')) AS now_, lower(string_agg(content, chr(10))) AS then_ FROM rn WHERE role <> 'assistant' GROUP BY conv_id),
ls AS (SELECT tk.conv_id, t, row_number() OVER (PARTITION BY tk.conv_id ORDER BY t) AS o FROM tk JOIN evd ON tk.conv_id = evd.conv_id WHERE NOT contains(now_, lower(t)) AND contains(then_, lower(t))),
lo AS (SELECT conv_id, string_agg(t, ',' ORDER BY t) AS lost FROM ls WHERE o <= 5 GROUP BY conv_id),
rm AS (SELECT conv_id, count(DISTINCT r) AS k FROM rn WHERE gone GROUP BY conv_id),
sx AS (SELECT cm.conv_id, CASE WHEN size < 3 THEN ['no_messages', ''] WHEN malformed THEN ['bad_structure', ''] WHEN middle = 0 THEN ['non_reducible', 'no_middle_rounds']
  WHEN plan_status IS NULL THEN ['parse_json', ''] WHEN plan_status = 'weird' THEN ['bad_status', 'weird'] WHEN plan_status <> 'reduce' THEN [plan_status, '']
  WHEN coalesce(k, 0) >= middle THEN ['skipped', 'remove_all_middle'] WHEN lost IS NOT NULL THEN ['non_reducible', 'grounding_loss:' || lost] ELSE ['reduce', ''] END AS s
  FROM cm LEFT JOIN rm ON cm.conv_id = rm.conv_id LEFT JOIN lo ON cm.conv_id = lo.conv_id)"""


@query(f"WITH {PLANNED_SQL} SELECT conv_id, s[1] AS status, s[2] AS reason FROM sx")
def critical_path_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("conv_id", "status", "reason")


@query(f"""WITH {PLANNED_SQL} SELECT rn.conv_id, row_number() OVER (PARTITION BY rn.conv_id ORDER BY pos) - 1 AS turn,
CASE WHEN r = 2 AND pos % 2 = 1 AND pos > 0 AND rn.conv_id % 2 = 0 THEN CASE WHEN regexp_matches(content, '(?s)<think>.*?</think>') THEN regexp_replace(content, '(?s)<think>.*?</think>', '<think>patched</think>') ELSE '<think>patched</think>' || chr(10) || content END ELSE content END AS content
FROM rn JOIN sx ON rn.conv_id = sx.conv_id WHERE s[1] = 'reduce' AND NOT gone""")
def critical_path_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = F.when(F.col("status") == "reduce", F.col("messages_new"))
    rows = _planned(spark, sf_dir).select("conv_id", F.posexplode_outer(reduced).alias("turn", "m")).filter("m IS NOT NULL")
    return longs(rows.select("conv_id", "turn", "m.content"))


@query(f"WITH {PLANNED_SQL} SELECT conv_id, lost FROM lo")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the final answer that only removed rounds had."""
    rows = rounds.with_rounds(tagged(spark, sf_dir, system=True)).filter(F.get("messages", F.size("messages") - 1)["role"] == "assistant")
    remove = F.filter(F.sequence(F.lit(1), F.col("final_round")), lambda r: (F.col("conv_id") + r) % 3 == 0)
    made = edit.planned(F.col("messages"), F.col("start"), F.col("middle"), remove, F.create_map().cast("map<int,string>"))
    return rows.select("conv_id", F.array_join(edit.lost_tokens(made, F.col("messages")), ",").alias("lost")).filter("lost <> ''")


#: Images are found again where the question comes first, so here system turns are left out.
@query(f"""WITH {PLANNED_SQL.replace(TAGGED_SYSTEM_SQL, TAGGED_SQL)}, {IMAGES_SQL},
kp AS (SELECT rn.conv_id, string_agg('img_' || im.pos || '_' || k, ',' ORDER BY im.pos, k) AS images FROM rn JOIN im ON rn.conv_id = im.conv_id AND rn.pos = im.pos JOIN sx ON rn.conv_id = sx.conv_id WHERE NOT gone OR s[1] <> 'reduce' GROUP BY rn.conv_id)
SELECT cm.conv_id, CASE WHEN cm.conv_id % 13 = 5 THEN 'no_original' WHEN cm.conv_id % 7 = 0 THEN 'unmatched' ELSE 'ok' END AS state, CASE WHEN cm.conv_id % 13 <> 5 AND cm.conv_id % 7 <> 0 THEN coalesce(images, '') END AS images
FROM cm LEFT JOIN kp ON cm.conv_id = kp.conv_id""")
def rebuild_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of conversations after critical-path deletion, found again by the hash of their original messages; some have
    lost these, and others were changed."""
    source = _with_images(tagged(spark, sf_dir)).select("messages", F.col("conv_id").alias("ord"), F.flatten("dealt").alias("images"))
    rows = _planned(spark, sf_dir, system=False)
    c, m = F.col("conv_id"), F.col("messages")
    rows = rows.select("conv_id", F.when(c % 13 == 5, None).when(c % 7 == 0, F.concat(m, F.slice(m, 1, 1))).otherwise(m).alias("original"), F.col("messages_new").alias("messages"), F.when(F.col("status") == "reduce", F.filter("remove", lambda r: (r >= 2) & (r <= F.col("middle") + 1))).otherwise(F.array().cast("array<int>")).alias("removed"))
    return edit.images_rejoined(rows, source).select("conv_id", "state", F.array_join("images", ",").alias("images"))


@query(f"""WITH {PLANNED_SQL}, pt AS (SELECT rn.conv_id, count(*) FILTER (WHERE rn.r = 2 AND pos % 2 = 1 AND rn.conv_id % 2 = 0 AND NOT gone) AS patched, count(*) AS n, count(*) FILTER (WHERE NOT gone) AS after FROM rn GROUP BY rn.conv_id)
SELECT count(*) AS reduced, count(*) FILTER (WHERE patched > 0) AS patched, count(*) FILTER (WHERE pt.conv_id % 2 = 0 AND 2 >= greatest(1, n // 2) + 1) AS final_patched, sum(n - after)::BIGINT AS saved FROM pt JOIN sx USING (conv_id) WHERE s[1] = 'reduce'""")
def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the reduced conversations had thoughts patched, and how many those of the final round."""
    rows = _planned(spark, sf_dir)
    kept = F.filter(F.map_keys("patches"), lambda r: ~F.array_contains(F.filter("remove", lambda x: (x >= 2) & (x <= F.col("middle") + 1)), r) & (r >= 2) & (r <= F.col("middle") + 2))
    return stats.patch_counts(rows.select("status", "patches", F.size("messages").alias("n_before"), F.size("messages_new").alias("n_after"), F.size(kept).alias("n_patched")))


@query(f"""WITH {TAGGED_SQL}, f AS (SELECT conv_id, content, {sql_strip("split_part(split_part(content, 'Input Question:', 2), 'Input image:', 1)")} AS q, {sql_strip("split_part(split_part(content, 'Input Question:', 2), 'Input image:', 2)")} AS i FROM tg WHERE pos = 0)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN content ELSE {sql_strip("split_part(split_part(content, 'Input Question:', 2), 'Input image: ', 1)")} END AS question, CASE WHEN q <> '' AND i <> '' THEN 'Ask: ' || q || ' [' || i || ']' END AS prompt FROM f""")
def question_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of conversations, some of which have a system message in front, and prompts refilled with them."""
    rows = tagged(spark, sf_dir)
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")))
    headed = F.when(F.col("conv_id") % 3 == 0, F.concat(system, F.col("messages"))).otherwise(F.col("messages"))
    first = F.get("messages", F.lit(0))["content"]
    return rows.select("conv_id", T.question_of(headed).alias("question"), T.refilled("Ask: {Question} [{ImageUrl}]", T.question_and_image(first)).alias("prompt"))


STATUS_SQL = f"WITH {PLANNED_SQL}"


@query(f"{STATUS_SQL} SELECT s[1] AS status, split_part(s[2], ':', 1) AS reason, count(*)::BIGINT AS n FROM sx GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).groupBy("status", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{STATUS_SQL} SELECT status, conv_id, rank FROM (SELECT s[1] AS status, conv_id, row_number() OVER (PARTITION BY s[1] ORDER BY conv_id) AS rank FROM sx) WHERE rank <= 3")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three conversations of every status; each task passes on three of a status at most."""
    first = Window.partitionBy("status").orderBy("conv_id")
    return longs(_planned(spark, sf_dir).select("status", "conv_id").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= 3))


BEFORE_AFTER = f"""{GRAPH_SQL},
ba AS (SELECT tg.conv_id, count(*) AS n_before, count(*) FILTER (WHERE ev.r IS NULL) AS n_after, sum(len(content)) AS chars_before, sum(len(content)) FILTER (WHERE ev.r IS NULL) AS chars_after
       FROM tg LEFT JOIN ev ON tg.conv_id = ev.conv_id AND (tg.pos + 3) // 2 = ev.r AND tg.pos > 0 GROUP BY tg.conv_id)"""


def _before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir)
    after = edit.compact(edit.evicted(F.col("messages"), F.col("evict")))
    both = rows.select("conv_id", stats.message_stats(F.col("messages")).alias("b"), stats.message_stats(after).alias("a"))
    return both.select("conv_id", F.col("b.n_msgs").alias("n_before"), F.col("a.n_msgs").alias("n_after"), F.col("b.total_chars").alias("chars_before"), F.col("a.total_chars").alias("chars_after"))


@query(f"""WITH {BEFORE_AFTER}
SELECT count(*)::BIGINT AS samples, round(avg(n_before), 4) AS avg_before, round(avg(n_after), 4) AS avg_after, round(100.0::DOUBLE * (sum(n_before) - sum(n_after)) / sum(n_before), 4) AS msg_reduction,
  round(100.0::DOUBLE * (sum(chars_before) - sum(chars_after)) / sum(chars_before), 4) AS char_reduction, count(*) FILTER (WHERE n_before > n_after) AS affected,
  round(100.0::DOUBLE * count(*) FILTER (WHERE n_before > n_after) / count(*), 4) AS affected_pct, (median(n_before - n_after) FILTER (WHERE n_before > n_after))::DOUBLE AS median_saved,
  (max(n_before - n_after) FILTER (WHERE n_before > n_after))::BIGINT AS max_saved FROM ba""")
def reduction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reduction_summary(_before_after(spark, sf_dir))


@query(f"WITH {BEFORE_AFTER} SELECT greatest(0, n_before - n_after)::BIGINT AS saved, count(*)::BIGINT AS n FROM ba GROUP BY ALL")
def saved_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_before_after(spark, sf_dir), F.greatest(F.lit(0), F.col("n_before") - F.col("n_after")), 1, "saved")


@query(f"WITH {BEFORE_AFTER} SELECT conv_id, (n_before - n_after)::BIGINT AS saved FROM ba WHERE n_before > n_after ORDER BY saved DESC, conv_id LIMIT 25")
def top_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that lose most messages."""
    rows = edited(spark, sf_dir)
    after = F.size(edit.compact(edit.evicted(F.col("messages"), F.col("evict"))))
    return longs(stats.largest_savings(rows.select("conv_id", F.size("messages").alias("n_before"), after.alias("n_after")), "conv_id", 25))


#: Defects put into conversations: the first turn doubled, or one left out; a system turn is one by itself.
def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounds.conversations(table(spark, sf_dir, "conversations"))
    m, c = F.col("messages"), F.col("conv_id")
    first = F.slice(m, 1, 1)
    return rows.withColumn("messages", F.when(c % 4 == 1, F.concat(first, m)).when(c % 4 == 2, F.filter(m, lambda x, i: i != 1)).when(c % 8 == 3, F.array().cast(rows.schema["messages"].dataType)).otherwise(m))


BROKEN_SQL = """
o AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN list_concat(m[1:1], m) WHEN conv_id % 4 = 2 THEN list_concat(m[1:1], m[3:]) WHEN conv_id % 8 = 3 THEN m[1:0] ELSE m END AS m FROM o)"""


def sql_alternates(m: str) -> str:
    return f"len(list_filter({m}, lambda x, i: x.role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0"


@query(f"WITH {BROKEN_SQL} SELECT conv_id, len(m)::BIGINT AS n, {sql_alternates('m')} AS ok FROM b")
def role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_broken(spark, sf_dir).select("conv_id", F.size("messages").alias("n"), rounds.alternates(F.col("messages")).alias("ok")))


@query(f"""WITH {BROKEN_SQL},
c AS (SELECT conv_id, m, CASE WHEN {sql_alternates('m')} THEN m ELSE NULL END AS whole,
  list_concat(flatten(list_transform(list_filter(range(1, len(m)), lambda i: m[i].role = 'user' AND m[i + 1].role = 'user' AND m[i].content = m[i + 1].content), lambda i: [i + 1, i])),
              list_filter(range(1, len(m) + 1), lambda i: m[i].role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) AS tries FROM b),
d AS (SELECT conv_id, whole, m, list_filter(tries, lambda i: {sql_alternates('list_concat(m[1:i - 1], m[i + 1:])')})[1] AS i FROM c),
e AS (SELECT conv_id, CASE WHEN whole IS NOT NULL THEN whole WHEN i IS NOT NULL THEN list_concat(m[1:i - 1], m[i + 1:]) END AS m FROM d)
SELECT conv_id, m IS NOT NULL AS ok, coalesce(len(m), -1)::BIGINT AS n, md5(coalesce(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), '|'), '')) AS digest FROM e""")
def role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = _broken(spark, sf_dir).select("conv_id", rounds.repair_roles(F.col("messages")).alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return longs(fixed.select("conv_id", F.col("m").isNotNull().alias("ok"), F.coalesce(F.size("m"), F.lit(-1)).alias("n"), F.md5(F.coalesce(said, F.lit(""))).alias("digest")))
