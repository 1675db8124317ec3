"""Queries over lengths, scores, selections, pages, converters and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundweave.functions import text as T
from roundweave.operators import convert, graph, select, stats
from roundweave.operators.rounds import conversations
from roundweave.plans.inputs import GRAPH_SQL, TAGGED_SQL, edited, longs, sql_answer_text, sql_bodies, sql_json, sql_strip, sql_think_text, table, tagged_turns

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


# lengths


@query("SELECT (n_chars // 1000 * 1000)::BIGINT AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), 1000)


@query("""WITH h AS (SELECT (n_chars // 500 * 500)::BIGINT AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY ALL)
SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS cum, round(100.0::DOUBLE * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 4) AS cum_pct FROM h""")
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cumulative(stats.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), 500))


@query("SELECT lang, round(avg(n_chars), 4) AS mean, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


# scores


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'Average' ELSE lang END AS category, count(*)::BIGINT AS n, round(100.0::DOUBLE * avg(quality), 4) AS accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.accuracy_by(rows, "lang", "quality")


#: What a judge says of a turn, with the whole turn after it.
GRADE = "CASE (conv_id + turn) % 5 WHEN 0 THEN ' A: ' || text WHEN 1 THEN chr(10) || 'Correct. ' || text WHEN 2 THEN text WHEN 3 THEN NULL ELSE 'incorrect ' || text END"


@query(f"""WITH g AS (SELECT {sql_strip(GRADE)} AS g FROM conversations)
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN starts_with(g, 'A') THEN 1 ELSE 0 END), 4) AS qa, round(avg(CASE WHEN starts_with(lower(g), 'correct') THEN 1 ELSE 0 END), 4) AS gaia FROM g""")
def judge_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").select(F.expr(GRADE).alias("g"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.judged_correct(F.col("g"))), 4).alias("qa"), F.round(F.avg(T.judged_correct(F.col("g"), "gaia")), 4).alias("gaia"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT round(avg(CASE WHEN n >= 7 THEN 1 ELSE 0 END), 4) AS stuck, round(avg(n), 4) AS avg_all, round(avg(n) FILTER (WHERE n < 7), 4) AS avg_free FROM c""")
def stuck_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of conversations of seven turns and more (the longest have eight here)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.round(F.avg((F.col("n") >= 7).cast("int")), 4).alias("stuck"), F.round(F.avg("n"), 4).alias("avg_all"), F.round(F.avg(F.when(F.col("n") < 7, F.col("n"))), 4).alias("avg_free"))


@query(f"""WITH {TAGGED_SQL} SELECT round(avg(CASE WHEN len({sql_bodies('content', 'think')}) >= 2 THEN 1 ELSE 0 END), 4) AS thinks, round(avg(CASE WHEN len({sql_bodies('content', 'tool_call')}) >= 2 THEN 1 ELSE 0 END), 4) AS calls
FROM tg WHERE role = 'assistant'""")
def multi_tag_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    many = lambda tag: F.round(F.avg((F.size(T.tag_bodies(c, tag)) >= 2).cast("int")), 4)
    return tagged_turns(spark, sf_dir).filter("role = 'assistant'").agg(many("think").alias("thinks"), many("tool_call").alias("calls"))


@query(f"WITH {GRAPH_SQL} SELECT k::BIGINT AS members, (count(*) // k)::BIGINT AS n FROM lb WHERE k > 1 GROUP BY k")
def merge_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array_distinct(F.transform(graph.strict_groups(F.col("pruned")), lambda g: g["members"]))
    sizes = edited(spark, sf_dir).select(F.explode(groups).alias("g")).select(F.size("g").cast("long").alias("members")).filter("members > 1")
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT lang, avg(quality) AS score, avg(n_chars) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT round(avg(score), 6) AS macro, round(avg(chars), 4) AS avg_chars, round(avg(chars) / (100 * avg(score)), 4) AS per_point FROM g""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    g = rows.groupBy("lang").agg(F.avg("quality").alias("score"), F.avg("n_chars").alias("chars"))
    return g.agg(F.round(F.avg("score"), 6).alias("macro"), F.round(F.avg("chars"), 4).alias("avg_chars"), F.round(F.avg("chars") / (100 * F.avg("score")), 4).alias("per_point"))


def _scaled(x: Column, by: int) -> Column:
    """A component's size times a whole number, rounded down; the product is a float, as in SQL, where Spark alone would take a double."""
    return F.floor(F.abs(x) * F.lit(by).cast("float"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding[1:len(embedding) // 2], lambda x: floor(abs(x) * 10)::INT % 3) AS p, list_transform(embedding[len(embedding) // 2 + 1:len(embedding) // 2 * 2], lambda x: CASE WHEN floor(abs(x) * 10)::INT % 4 = 3 THEN -100 ELSE floor(abs(x) * 10)::INT % 4 END) AS l FROM embeddings),
q AS (SELECT vec_id, p, l, list_filter(range(1, len(l)), lambda i: l[i + 1] <> -100) AS c FROM p)
SELECT vec_id, round(len(list_filter(c, lambda i: p[i] = l[i + 1]))::DOUBLE / nullif(len(c), 0), 6) AS accuracy FROM q""")
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: _scaled(x, 10).cast("int"))
    half = F.floor(F.size("embedding") / 2).cast("int")
    predicted = F.transform(F.slice(e, F.lit(1), half), lambda x: x % 3)
    labels = F.transform(F.slice(e, half + 1, half), lambda x: F.when(x % 4 == 3, -100).otherwise(x % 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(stats.masked_accuracy(predicted, labels), 6).alias("accuracy"))


@query("""WITH s AS (SELECT label, list_sum(list_transform(embedding[1:len(embedding) // 2], lambda x: floor(x * 256)::BIGINT)) AS a, list_sum(list_transform(embedding[len(embedding) // 2 + 1:], lambda x: floor(x * 256)::BIGINT)) AS b FROM embeddings)
SELECT label::BIGINT AS label, round(avg(CASE WHEN a > b THEN 1 ELSE 0 END), 6) AS accuracy FROM s GROUP BY label""")
def preference_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the reward of the chosen half of the components is above that of the rejected one."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    reward = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + F.floor(x * 256).cast("long"))
    won = reward(F.slice("embedding", F.lit(1), half)) > reward(F.slice("embedding", half + 1, F.size("embedding")))
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.avg(won.cast("int")), 6).alias("accuracy"))


@query("""SELECT count(*)::BIGINT AS n, round(avg(p), 4) AS perplexity FROM
(SELECT exp(list_avg(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE))) AS p FROM embeddings) WHERE p IS NOT NULL""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean perplexity, with positive components as losses of tokens and others masked."""
    kept = F.transform(F.filter("embedding", lambda x: x > 0), lambda x: x.cast("double"))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    p = table(spark, sf_dir, "embeddings").select(F.when(F.size(kept) > 0, F.exp(mean)).alias("p")).filter("p IS NOT NULL")
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("perplexity"))


@query("""WITH t AS (SELECT sum(len(list_filter(embedding, lambda x: x > 0))) AS valid, sum(len(embedding)) AS total FROM embeddings)
SELECT round(valid / total, 6) AS ratio, round(3e-4 * sqrt(2048 * 16 * (valid / total) / 4e6), 10) AS lr, round(3e-4 * sqrt(2048 * 16 * (valid / total) / 4e6) / 6.0, 10) AS lr_small FROM t""")
def suggested_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rate by the square root of the batch's valid tokens."""
    t = table(spark, sf_dir, "embeddings").agg((F.sum(F.size(F.filter("embedding", lambda x: x > 0))) / F.sum(F.size("embedding"))).alias("ratio"))
    lr = F.lit(3e-4) * F.sqrt(F.lit(2048.0 * 16) * F.col("ratio") / F.lit(4e6))
    return t.select(F.round("ratio", 6).alias("ratio"), F.round(lr, 10).alias("lr"), F.round(lr / 6.0, 10).alias("lr_small"))


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 1.8::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + exp(-0.05::DOUBLE * len(embedding))) - 0.5) AS w FROM embeddings)
SELECT vec_id, round(list_reduce(list_concat([v[1]], v), lambda a, x: a * w + (1 - w) * x), 6) AS last FROM w""")
def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(stats.smoothed(v), -1), 6).alias("last"))


@query("""WITH h AS (SELECT substring(text, len(text) // 2 + 1) AS p, substring(text, 1, len(text) // 2) AS l FROM benchmark),
w AS (SELECT regexp_extract_all(p, '[^ \\t\\n\\x0B\\f\\r]+') AS p, regexp_extract_all(l, '[^ \\t\\n\\x0B\\f\\r]+') AS l FROM h),
g AS (SELECT list_distinct(p) AS p1, list_distinct(l) AS l1, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) AS p2, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS l2 FROM w),
f AS (SELECT CASE WHEN len(p1) > 0 AND len(l1) > 0 THEN 200.0::DOUBLE * len(list_intersect(p1, l1)) / (len(p1) + len(l1)) ELSE 0 END AS a, CASE WHEN len(p2) > 0 AND len(l2) > 0 THEN 200.0::DOUBLE * len(list_intersect(p2, l2)) / (len(p2) + len(l2)) ELSE 0 END AS b FROM g)
SELECT round(avg(a), 4) AS rouge1, round(avg(b), 4) AS rouge2, count(*)::BIGINT AS n FROM f""")
def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE-1 and ROUGE-2 of the second half of each benchmark text against its first."""
    half = F.floor(F.length("text") / 2).cast("int")
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    rows = table(spark, sf_dir, "benchmark").select(words(F.substring(F.col("text"), half + 1, F.length("text"))).alias("p"), words(F.substring(F.col("text"), F.lit(1), half)).alias("l"))
    scores = rows.select(stats.rouge(F.col("p"), F.col("l"), 1).alias("a"), stats.rouge(F.col("p"), F.col("l"), 2).alias("b"))
    return scores.agg(F.round(F.avg("a"), 4).alias("rouge1"), F.round(F.avg("b"), 4).alias("rouge2"), F.count(F.lit(1)).alias("n"))


WORDS = r"regexp_extract_all({}, '[^ \t\n\x0B\f\r]+')"


def _rouge_sql(n: int) -> str:
    """ROUGE-n F1 of the words in ``a`` and ``b``."""
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"
    return f"CASE WHEN len(a) >= {n} AND len(b) >= {n} THEN 2.0::DOUBLE * len(list_intersect({grams('a')}, {grams('b')})) / (len({grams('a')}) + len({grams('b')})) ELSE 0 END"


#: BLEU-4 by counts of n-grams; the common subsequence a row of its table per word of ``a``, the best so far at each word of ``b``.
SCORES_SQL = f"""WITH RECURSIVE h AS (SELECT item_id, substring(text, len(text) // 2 + 1) AS p, substring(text, 1, len(text) // 2) AS l FROM benchmark),
w AS (SELECT item_id, p, l, {WORDS.format('p')} AS a, {WORDS.format('l')} AS b FROM h),
o AS (SELECT item_id, p, l, unnest([1, 2, 3, 4]) AS n FROM h),
g AS (SELECT item_id, n, substring(p, i, n) AS gram, 1 AS x, 0 AS y FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM o)
      UNION ALL SELECT item_id, n, substring(l, i, n), 0, 1 FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS i FROM o)),
c AS (SELECT item_id, n, sum(least(x, y)) AS hits FROM (SELECT item_id, n, gram, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL) GROUP BY ALL),
m AS (SELECT o.item_id, o.n, len(p) AS np, len(l) AS nl, coalesce(hits, 0) AS hits, greatest(1, len(p) - o.n + 1) AS total, count(*) FILTER (WHERE coalesce(hits, 0) = 0) OVER (PARTITION BY o.item_id ORDER BY o.n) AS misses
      FROM o LEFT JOIN c ON o.item_id = c.item_id AND o.n = c.n),
bl AS (SELECT item_id, CASE WHEN any_value(np) = 0 OR any_value(nl) = 0 OR max(hits) FILTER (WHERE n = 1) = 0 THEN 0
         ELSE exp(sum(0.25::DOUBLE * ln(CASE WHEN hits = 0 THEN 1.0::DOUBLE / (2 ** misses * total) ELSE hits::DOUBLE / total END))) * CASE WHEN any_value(np) > any_value(nl) THEN 1 ELSE exp(1 - any_value(nl)::DOUBLE / any_value(np)) END END AS s FROM m GROUP BY item_id),
lc(item_id, i, row) AS (SELECT item_id, 0, list_transform(range(0, len(b) + 1), lambda j: 0) FROM w
  UNION ALL SELECT w.item_id, i + 1, list_transform(range(1, len(b) + 2), lambda j: greatest(row[j], coalesce(list_max(list_transform(range(1, j), lambda k: CASE WHEN b[k] = a[i + 1] THEN row[k] + 1 END)), 0)))
  FROM lc JOIN w ON w.item_id = lc.item_id WHERE i < len(a)),
f AS (SELECT w.item_id, bl.s AS bleu4, {_rouge_sql(1)} AS rouge1, {_rouge_sql(2)} AS rouge2, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0::DOUBLE * row[len(b) + 1] / (len(a) + len(b)) ELSE 0 END AS rougel
      FROM w JOIN bl ON bl.item_id = w.item_id JOIN lc ON lc.item_id = w.item_id AND lc.i = len(a))
SELECT {', '.join(f"round(avg(round(100 * {c}, 4)), 4) AS {c}" for c in ('bleu4', 'rouge1', 'rouge2', 'rougel'))} FROM f"""


@query(SCORES_SQL)
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean BLEU-4 and ROUGE of the second half of each benchmark text against its first."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = table(spark, sf_dir, "benchmark").select(stats.text_scores(F.substring(F.col("text"), half + 1, F.length("text")), F.substring(F.col("text"), F.lit(1), half)).alias("s")).select("s.*")
    return rows.agg(*(F.round(F.avg(c), 4).alias(c) for c in rows.columns))


@query("""WITH m AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: floor(abs(x) * 40)::INT % 4)) AS m FROM embeddings),
l AS (SELECT vec_id, list_filter(list_transform(range(1, 4), lambda k: len(list_filter(m, lambda x: x = k))), lambda n: n > 0) AS l FROM m)
SELECT vec_id, array_to_string(l, ',') AS lengths, '0' || coalesce(',' || nullif(array_to_string(list_transform(range(1, len(l) + 1), lambda i: list_sum(l[1:i])), ','), ''), '') AS offsets, coalesce(list_max(l), 0)::BIGINT AS longest FROM l""")
def packing_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array_sort(F.transform("embedding", lambda x: (_scaled(x, 40) % 4).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", stats.sequence_lengths(mask).alias("l"), stats.sequence_offsets(mask).alias("o"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("vec_id", text(F.col("l")).alias("lengths"), text(F.col("o")).alias("offsets"), F.coalesce(F.array_max("l"), F.lit(0)).cast("long").alias("longest"))


# selection


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 2 OFFSET 6")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth page of two rows."""
    return select.page(table(spark, sf_dir, "benchmark"), "item_id", 3)


@query("""WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark) SELECT w."at"::BIGINT AS "at", item_id FROM b JOIN (VALUES (0, 5), (1, 0), (2, 5), (3, 12)) w("at", p) USING (p)""")
def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a list of positions, repeats and order kept."""
    b = select.numbered(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "p")
    return select.select(b, "p", [5, 0, 5, 12], 20).select("at", "item_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return select.pending(docs.select("doc_id"), "doc_id", table(spark, sf_dir, "labels").filter("quality = 1"), docs.filter("lang = 'de'"))


@query("""SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE conv_id NOT IN
(SELECT conv_id FROM conversations WHERE turn = 1 AND trim(text) <> '' AND conv_id % 3 >= 1)""")
def resume_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = turns.filter("turn = 1").select(F.col("conv_id").alias("question"), F.col("text").alias("response"), (F.col("conv_id") % 3).alias("num_tool_calls"))
    return select.pending_by_question(turns.select(F.col("conv_id").alias("question")).distinct(), done).select(F.col("question").alias("conv_id"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents without replacement; which ones is up to the hash."""
    return select.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, seed=42)


@query("""WITH t AS (SELECT conv_id, role, text, sha256(text) AS h FROM conversations WHERE turn = 0),
s AS (SELECT h, arg_max('img_' || conv_id, conv_id) AS image FROM t WHERE role = 'user' GROUP BY h)
SELECT conv_id, image FROM t LEFT JOIN s USING (h)""")
def hash_match_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of conversations that a user opens, found again by the hash of the first turn; of several the last counts."""
    t = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", "role", F.sha2("text", 256).alias("h"))
    s = select.latest(t.filter("role = 'user'").withColumn("image", F.concat(F.lit("img_"), "conv_id")), "h", "image", "conv_id")
    return t.join(s, "h", "left").select("conv_id", "image")


@query("""WITH p AS (SELECT conv_id, unnest(list_transform(range(0, len(text) // 60 + 1), lambda k: CASE WHEN (conv_id + k) % 3 = 0 THEN 'img/' ELSE '/img/' END || (conv_id * 7 + k) % 50 || '.png')) AS path FROM conversations)
SELECT count(*)::BIGINT AS n, count(DISTINCT path)::BIGINT AS distinct_n, count(*) FILTER (WHERE NOT starts_with(path, '/'))::BIGINT AS relative_n, count(DISTINCT path) FILTER (WHERE NOT ends_with(path, '0.png'))::BIGINT AS missing_n FROM p""")
def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sequence(F.lit(0), F.floor(F.length("text") / 60).cast("int"))
    name = F.transform(k, lambda i: F.concat(F.when((F.col("conv_id") + i) % 3 == 0, "img/").otherwise("/img/"), (F.col("conv_id") * 7 + i) % 50, F.lit(".png")))
    paths = select.image_paths(table(spark, sf_dir, "conversations").select("conv_id", name.alias("images")))
    listing = paths.select("path").distinct().filter(F.endswith("path", F.lit("0.png")))
    missing = select.missing_images(paths, listing).agg(F.count(F.lit(1)).alias("missing_n"))
    return paths.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("distinct_n"), F.count_if("relative").alias("relative_n")).crossJoin(F.broadcast(missing))


MIX_SQL = """s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p FROM documents WHERE lang IS NOT NULL),
c AS (SELECT lang, count(*) AS n FROM s GROUP BY lang), """


def _sources(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The documents of each language as a source, numbered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").filter("lang IS NOT NULL")
    rows = select.numbered(docs, "doc_id", "p", by="lang")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    return {lang: rows.filter(F.col("lang") == lang) for lang in sorted(counts)}, counts


@query(f"WITH {MIX_SQL} z AS (SELECT min(n) AS k FROM c) SELECT doc_id, p AS turn, lang AS _dataset_name FROM s, z WHERE p < k")
def interleave_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.interleaved(*_named(spark, sf_dir)).select("doc_id", "turn", "_dataset_name")


@query(f"""WITH {MIX_SQL} z AS (SELECT max(n) AS k FROM c), r AS (SELECT s.doc_id, s.lang, unnest(range(0, (k + n - 1) // n)) * n + p AS turn, k FROM s JOIN c USING (lang), z)
SELECT doc_id, turn, lang AS _dataset_name FROM r WHERE turn < k""")
def interleave_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.interleaved(*_named(spark, sf_dir), over=True).select("doc_id", "turn", "_dataset_name")


def _named(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], str, dict[str, int]]:
    named, counts = _sources(spark, sf_dir)
    return named, "p", counts


@query(f"""WITH {MIX_SQL}
o AS (SELECT lang, n, row_number() OVER (ORDER BY lang) AS k, count(*) OVER () AS m FROM c),
u AS (SELECT i AS turn, ('0x' || substr(md5('3:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM (SELECT unnest(range(0, (SELECT sum(n) FROM c)::BIGINT + 1)) AS i)),
t AS (SELECT turn, least(floor(u * m)::BIGINT + 1, m) AS k FROM u, (SELECT max(m) AS m FROM o)),
r AS (SELECT t.turn, o.lang, o.n, row_number() OVER (PARTITION BY o.lang ORDER BY turn) - 1 AS p FROM t JOIN o USING (k)),
e AS (SELECT min(turn) AS stop FROM r WHERE p >= n)
SELECT s.doc_id, r.turn, r.lang AS _dataset_name FROM r JOIN s ON r.lang = s.lang AND r.p = s.p, e WHERE turn < stop""")
def interleave_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages drawn by chance, each with the same share, until one is used up."""
    named, key, counts = _named(spark, sf_dir)
    return select.drawn(named, key, counts, [1 / len(counts)] * len(counts), seed=3).select("doc_id", "turn", "_dataset_name")


@query("""SELECT doc_id, 'long' AS _dataset_name FROM (SELECT doc_id FROM documents WHERE n_chars > 3000 ORDER BY doc_id LIMIT 50)
UNION ALL SELECT doc_id, 'short' FROM (SELECT doc_id FROM documents WHERE n_chars <= 3000 ORDER BY doc_id LIMIT 50)""")
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as two sources under each other; the option takes the first fifty rows of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return select.concatenated({"long": docs.filter("n_chars > 3000"), "short": docs.filter("n_chars <= 3000")}, 50, "doc_id").select("doc_id", "_dataset_name")


@query("SELECT doc_id, ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.1 AS held_out FROM documents")
def val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents held out, by hash."""
    return select.split_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) <= 70 AS held_out FROM documents")
def val_split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventy documents held out."""
    return select.split_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 70)


@query("""SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('5:' || conv_id), conv_id LIMIT 20)""")
def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of twenty conversations drawn by their ids."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return turns.join(select.sample(turns.select("conv_id").distinct(), "conv_id", 20, seed=5), "conv_id", "left_semi")


@query("""SELECT d.doc_id AS _idx, d.n_chars::BIGINT AS before, strlen(d.text)::BIGINT AS after FROM documents d""")
def zip_by_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the documents side by side by number."""
    docs = table(spark, sf_dir, "documents")
    one = docs.select(F.col("doc_id").alias("_idx"), F.col("n_chars").cast("long").alias("before"))
    return select.zipped(one, docs.select(F.col("doc_id").alias("_idx"), F.octet_length("text").cast("long").alias("after")))


@query("""WITH k AS (SELECT sha256(text) AS key, max(item_id) AS item_id FROM benchmark WHERE item_id % 3 = 0 GROUP BY ALL)
SELECT b.item_id, coalesce('cached ' || k.item_id, b.text) AS made FROM benchmark b LEFT JOIN k ON sha256(b.text) = k.key""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache has for a text, else the text itself."""
    items = table(spark, sf_dir, "benchmark").withColumn("key", F.sha2("text", 256))
    cache = items.filter("item_id % 3 = 0").groupBy("key").agg(F.concat(F.lit("cached "), F.max("item_id")).alias("value"))
    return select.looked_up(items, cache, "key", "text", "made").select("item_id", "made")


@query("""WITH c AS (SELECT conv_id, max(text) FILTER (WHERE role = 'system') AS s, max(CASE WHEN role = 'assistant' AND contains(text, chr(10)) THEN text ELSE '' END) AS a, max(text) FILTER (WHERE role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN s <> '' THEN s WHEN a <> '' THEN a WHEN u <> '' THEN u END AS question FROM c""")
def first_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation is called: a system turn, else a turn of several lines of the assistant, else one of the user."""
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    lines = F.max(F.when((F.col("role") == "assistant") & F.contains("text", F.lit("\n")), F.col("text")).otherwise(""))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("system").alias("s"), lines.alias("a"), of("user").alias("u"))
    return c.select("conv_id", T.first_truthy(F.col("s"), F.col("a"), F.col("u")).alias("question"))


# pages


@query(f"""SELECT page_id, coalesce(html = '' OR regexp_matches(lower(substring(html, 1, 2000)), '{'|'.join(T.BLOCKED + ['ndble'])}'), true) AS blocked FROM pages""")
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say they are blocked; one invented word counts as well, as no page here does."""
    c = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", (T.is_blocked(c) | F.coalesce(F.contains(F.lower(F.substring(c, 1, 2000)), F.lit("ndble")), F.lit(True))).alias("blocked"))


LINK = """CASE page_id % 8 WHEN 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || page_id || '/' WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || page_id || '/'
WHEN 2 THEN 'https://www.biorxiv.org/content/10.1101/2020.' || page_id || 'v1?x=1#top' WHEN 3 THEN 'https://doi.org/10.1000/a.' || page_id || '?q/'
WHEN 4 THEN 'https://academic.oup.com/x/10.1093/y' || page_id || '?z' WHEN 5 THEN 'https://www.medrxiv.org/content/1.full.pdf' ELSE url END"""
HOST_SQL = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {LINK} AS u FROM pages), h AS (SELECT *, {HOST_SQL} AS h, rtrim(split_part(split_part(u, '?', 1), '#', 1), '/') AS c FROM p)
SELECT page_id, CASE WHEN contains(h, 'pmc.ncbi.nlm.nih.gov') THEN 'pmc' WHEN contains(h, 'pubmed.ncbi.nlm.nih.gov') THEN 'pubmed' WHEN contains(h, 'biorxiv.org') OR contains(h, 'medrxiv.org') THEN 'preprint'
  WHEN h IN ({', '.join(f"'{x}'" for x in T.PAYWALLED)}) THEN 'paywalled' ELSE 'plain' END AS route,
  regexp_extract(u, '(PMC[0-9]+)', 1) AS pmc, regexp_extract(u, 'pubmed\\.ncbi\\.nlm\\.nih\\.gov/([0-9]+)', 1) AS pubmed,
  rtrim(CASE WHEN regexp_matches(u, 'doi\\.org/(10\\.[0-9]{{4,}}/[^\\s]+)') THEN regexp_extract(u, 'doi\\.org/(10\\.[0-9]{{4,}}/[^\\s]+)', 1) ELSE regexp_extract(u, '/(10\\.[0-9]{{4,}}/[^\\s?#]+)', 1) END, '/') AS doi,
  CASE WHEN NOT (contains(u, 'biorxiv.org') OR contains(u, 'medrxiv.org')) THEN '' WHEN ends_with(c, '.pdf') THEN u WHEN contains(c, '/content/') THEN c || '.full.pdf' ELSE '' END AS pdf FROM h""")
def url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return table(spark, sf_dir, "pages").select("page_id", F.expr(LINK).alias("u")).select("page_id", T.route(u).alias("route"), T.pmc_id(u).alias("pmc"), T.pubmed_id(u).alias("pubmed"), T.doi(u).alias("doi"), T.preprint_pdf(u).alias("pdf"))


# texts


@query(f"""WITH {TAGGED_SQL} SELECT conv_id, CASE WHEN contains(content, 'Input Question:') AND contains(content, 'Input image:') THEN {sql_strip("split_part(split_part(content, 'Input Question:', 2), 'Input image:', 1)")} ELSE content END AS question FROM tg WHERE pos = 0""")
def question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_turns(spark, sf_dir).filter("turn = 0").select("conv_id", T.question_text(F.col("text")).alias("question"))


@query("""SELECT doc_id, md5(CASE WHEN len(text) <= 900 + 200 + 40 THEN text ELSE substring(text, 1, 900) || chr(10) || '...[' || (len(text) - 1100) || ' chars elided]...' || chr(10) || right(text, 200) END) AS digest FROM documents""")
def elide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.elide(F.col("text"))).alias("digest"))


@query("""WITH r AS (SELECT conv_id, turn, '**Round ' || turn || '** (' || role || '):' || chr(10) || CASE WHEN len(text) <= 190 THEN text ELSE substring(text, 1, 100) || chr(10) || '...[' || (len(text) - 150) || ' chars elided]...' || chr(10) || right(text, 50) END AS s FROM conversations)
SELECT conv_id, md5(string_agg(s, chr(10) ORDER BY turn)) AS digest FROM r GROUP BY conv_id""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one prompt, its turns elided."""
    piece = F.concat(F.lit("**Round "), "turn", F.lit("** ("), "role", F.lit("):\n"), T.elide(F.col("text"), 100, 50))
    rows = conversations(table(spark, sf_dir, "conversations"), piece)
    return rows.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\n")).alias("digest"))


#: Labels of turns as a model writes them: with decoration, and the whole turn behind.
PART = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'Round ' || text WHEN 1 THEN ' Round ' || turn || ' tool_call ' || text WHEN 2 THEN 'tool_call_' || text ELSE chr(10) || replace(text, ' ', '_') || ' x' END"


@query(f"""WITH p AS (SELECT conv_id, turn, {PART} AS part FROM conversations)
SELECT conv_id, turn, split_part({sql_strip("replace(replace(replace(part, 'Round ', ''), 'tool_call', ''), '_', '')")}, ' ', 1) AS label FROM p""")
def label_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_label(F.expr(PART)).alias("label"))


def _reply(record: str) -> str:
    """Replies to a request for JSON, some with the whole turn around it."""
    return f"""CASE (conv_id + turn) % 6 WHEN 0 THEN {record} WHEN 1 THEN text || ' ```json' || chr(10) || {record} || chr(10) || '``` ' || text WHEN 2 THEN text || ' [' || {record} || '] ' || text
WHEN 3 THEN text WHEN 4 THEN text || ' ' || {record} || ' ' || text ELSE substring({record}, 1, length({record}) - 1) END"""


FENCE = "'(?s)```(?:json|JSON)?\\s*\\n?(.*?)\\n?```'"


@query(f"""WITH r AS (SELECT conv_id, turn, {sql_strip(_reply("(to_json({'text': text, 'number': conv_id})::VARCHAR)"))} AS c FROM conversations),
f AS (SELECT *, {sql_strip(f"regexp_extract(c, {FENCE}, 1)")} AS f, regexp_matches(c, {FENCE}) AS fenced FROM r),
b AS (SELECT *, [c, f, regexp_extract(CASE WHEN fenced THEN f ELSE c END, '(?s)\\[.*\\]'), regexp_extract(CASE WHEN fenced THEN f ELSE c END, '(?s)\\{{.*\\}}')] AS tries FROM f),
j AS (SELECT conv_id, turn, list_filter(tries, lambda x: json_valid(x))[1] AS j FROM b)
SELECT conv_id, turn, coalesce(json_extract_string(j, '$.text'), json_extract_string(j, '$[0].text')) AS said, coalesce(json_extract_string(j, '$.number'), json_extract_string(j, '$[0].number'))::BIGINT AS number, j IS NOT NULL AS parsed FROM j""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in replies of several forms, each with the whole turn in it."""
    rows = table(spark, sf_dir, "conversations").withColumn("v", T.lenient_json(F.expr(_reply("to_json(named_struct('text', text, 'number', conv_id))"))))
    got = lambda name, kind: F.coalesce(*(F.try_variant_get("v", f"{at}.{name}", kind) for at in ("$", "$[0]"))).alias(name)
    return rows.select("conv_id", "turn", got("text", "string").alias("said"), got("number", "bigint"), F.col("v").isNotNull().alias("parsed"))


@query(f"""WITH {TAGGED_SQL}, b AS (SELECT conv_id, pos, {sql_bodies('content', 'tool_call')} AS b FROM tg WHERE role = 'assistant')
SELECT conv_id, pos AS turn, len(list_filter(b, lambda x: NOT json_valid(x))) > 0 AS bad, CASE WHEN len(list_filter(b, lambda x: NOT json_valid(x))) = 0 THEN len(b) END::BIGINT AS n FROM b""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged_turns(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", convert.tool_calls(F.col("text")).alias("t"))
    return longs(rows.select("conv_id", "turn", F.col("t.error").isNotNull().alias("bad"), F.size("t.calls").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n"))))


def _call(text: str) -> str:
    """Calls whose arguments are whole turns; ``text`` is the turn as a JSON string."""
    return f"""CASE (conv_id + turn) % 7 WHEN 0 THEN '{{"name":"Search","arguments":{{"q":' || {text} || '}}}}' WHEN 1 THEN '{{"tool_name":" open_url ","parameters":{{"urls":' || {text} || '}}}}' WHEN 2 THEN '{{"name":"visit","arguments":{{"url":"","code":' || {text} || '}}}}'
WHEN 3 THEN '{{"name":"VLSearchImage","arguments":{{"image":"","image_url":' || {text} || '}},"parameters":{{"images":"p"}}}}' WHEN 4 THEN '{{"name":"","arguments":{{"code":' || {text} || '}}}}' WHEN 5 THEN '{{"name":' || {text} || '}}'
ELSE '{{"name":"run_python","parameters":{{"code_block":' || {text} || '}}}}' END"""


JSON_TEXT = "substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"


def _call_sql() -> str:
    """The table of tools as SQL over ``named`` and the call ``c``."""
    field = lambda path: f"nullif(json_extract_string(c, '$.{path}'), '')"
    tool, argument, error = "", "", ""
    for own, aliases, names, shown in convert.TOOLS:
        known = f"WHEN lower(named) IN ({', '.join(repr(a) for a in aliases)}) THEN"
        given = f"coalesce({', '.join(field(f'{part}.{n}') for part in ('arguments', 'parameters') for n in names)})"
        tool, argument = f"{tool} {known} '{own}'", f"{argument} {known} {given}"
        error = f"{error} {known} CASE WHEN {given} IS NULL THEN '[{own}] Missing ''{shown}'' argument.' END"
    unknown = "'Invalid tool name ' || chr(39) || named || chr(39) || '. Available tools: web_search, visit, code_interpreter, image_search.'"
    return f"""WITH r AS (SELECT conv_id, turn, {_call('to_json(text)::VARCHAR')} AS c FROM conversations), n AS (SELECT *, {sql_strip(f"coalesce({field('name')}, {field('tool_name')}, '')")} AS named FROM r)
    SELECT conv_id, turn, CASE {tool} END AS tool, CASE {argument} END AS argument, CASE WHEN named = '' THEN '"name" field is required. Specify a tool name' {error} ELSE {unknown} END AS error FROM n"""


@query(_call_sql())
def call_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", convert.normalised_call(F.expr(_call(JSON_TEXT))).alias("c")).select("conv_id", "turn", "c.*")


# converters and traces


@query("""WITH b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'sys' END AS system, substring(text, 1, len(text) // 3) AS instruction, CASE WHEN item_id % 2 = 0 THEN substring(text, len(text) // 3 + 1, len(text) // 3) END AS input, CASE WHEN item_id % 5 <> 0 THEN substring(text, len(text) // 3 * 2 + 1) END AS output FROM benchmark),
m AS (SELECT item_id, 1 AS k, 'system' AS role, system AS value, 0.0::DOUBLE AS w FROM b WHERE system IS NOT NULL UNION ALL SELECT item_id, 2, 'user', instruction || coalesce(input, ''), 0.0 FROM b UNION ALL SELECT item_id, 3, 'assistant', output, 1.0 FROM b WHERE output IS NOT NULL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS pos, role, value, w::DOUBLE AS loss_weight FROM m""")
def alpaca_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("item_id"), F.col("text")
    third = F.floor(F.length(text) / 3).cast("int")
    made = convert.converter("alpaca")(F.when(i % 3 == 0, "sys"), F.substring(text, F.lit(1), third), F.when(i % 2 == 0, F.substring(text, third + 1, third)), F.when(i % 5 != 0, F.substring(text, third * 2 + 1, F.length(text))))
    return longs(table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(made).alias("pos", "m")).select("item_id", "pos", "m.*"))


@query("""WITH b AS (SELECT item_id, substring(text, 1, 4 * n) || chr(10) || 'A. ' || substring(text, 4 * n + 1, n) || chr(10) || 'B. ' || substring(text, 5 * n + 1, n) || chr(10) || 'C. ' || substring(text, 6 * n + 1, n) || chr(10) || 'D. ' || substring(text, 7 * n + 1) || chr(10) || 'Answer:' AS q,
  CASE item_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS a FROM (SELECT *, len(text) // 8 AS n FROM benchmark)),
s AS (SELECT b.item_id, c.item_id AS k, c.q, c.a FROM b JOIN b c ON c.item_id BETWEEN b.item_id - 2 AND b.item_id)
SELECT item_id, md5('The following are multiple choice questions (with answers) about facts.' || chr(10) || chr(10) || string_agg('user:' || q || '|assistant:' || a, '|' ORDER BY k)) AS digest FROM s GROUP BY item_id""")
def fewshot_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice prompts with the two items before as examples; one range join over neighbours."""
    text, i = F.col("text"), F.col("item_id")
    n = F.floor(F.length(text) / 8).cast("int")
    example = F.struct(F.substring(text, F.lit(1), 4 * n).alias("question"), *(F.substring(text, (4 + k) * n + 1, n if c != "D" else F.length(text)).alias(c) for k, c in enumerate("ABCD")), F.element_at(F.array(*map(F.lit, "ABCD")), (i % 4 + 1).cast("int")).alias("answer"))
    items = table(spark, sf_dir, "benchmark").select("item_id", example.alias("e"))
    shown = items.select(F.explode(F.array(i, i + 1, i + 2)).alias("item_id"), i.alias("k"), F.col("e").alias("shown"))
    sets = items.join(shown.filter(F.col("k") < F.col("item_id")), "item_id", "left").groupBy("item_id").agg(F.first("e").alias("e"), F.sort_array(F.collect_list(F.struct("k", "shown"))).alias("s"))
    support = F.transform(F.filter("s", lambda x: x["k"].isNotNull()), lambda x: x["shown"])
    made = convert.few_shot(F.col("e"), support, "facts")
    head = convert.CHOICE_TEMPLATES["en"][0].format(subject="facts")
    whole = F.array_join(F.transform(made, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return sets.select("item_id", F.md5(F.concat(F.lit(head), F.replace(whole, F.lit("user:" + head), F.lit("user:")))).alias("digest"))


@query("""WITH o AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, CASE WHEN r[1] = 'system' THEN r[2:] ELSE r END AS r FROM o)
SELECT conv_id, CASE WHEN len(r) % 2 = 0 THEN 'Only supports u/a/u/a/u...' WHEN len(list_filter(r, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'Invalid role' END AS error FROM p""")
def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", convert.request_error(F.col("messages")).alias("error"))


def _output(text: str) -> str:
    """Outputs of a model around whole turns; ``text`` is the turn as a JSON string."""
    return f"""CASE (conv_id + turn) % 7 WHEN 0 THEN '<think>' || text || '</think><tool_call>{{"name":"search","arguments":{{"q":' || {text} || '}}}}</tool_call> <tool_call> {{"name":"visit"}} </tool_call>'
WHEN 1 THEN text WHEN 2 THEN '<think>' || text || '</think><answer> ' || text || ' </answer>' WHEN 3 THEN '<think>x</think><tool_call>' || text || '</tool_call>' WHEN 4 THEN text || ' </think> rest' WHEN 5 THEN '<think> ' || text
ELSE text || '<tool_call>{{"arguments":{{"q":' || {text} || '}}}}</tool_call><tool_call>[1]</tool_call>' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_output('to_json(text)::VARCHAR')} AS o, [coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), 'page ' || turn] AS res FROM conversations),
p AS (SELECT *, contains(o, '<think>') AS th, contains(o, '<tool_call>') AS tc, contains(o, '<answer>') AS an, {sql_bodies('o', 'tool_call')} AS b FROM r),
q AS (SELECT *, tc AND len(list_filter(b, lambda x: NOT json_valid(x))) = 0 AS good, NOT th AND NOT tc AND NOT an AS plain, list_filter(b, lambda x: CASE WHEN json_valid(x) THEN json_type(x) = 'OBJECT' ELSE false END) AS calls FROM p),
s AS (SELECT *, CASE WHEN plain THEN '<think>' || o || '</think>' ELSE '' END || CASE WHEN th OR contains(o, '</think>') THEN '<think>' || {sql_think_text('o')} || '</think>' ELSE '' END AS head FROM q),
t AS (SELECT *, CASE WHEN good THEN head || '<tool_call>' || array_to_string(calls, '') || '</tool_call>' WHEN tc THEN o ELSE head END AS body FROM s)
SELECT conv_id, turn, CASE WHEN an THEN 'answer' WHEN good THEN 'call' WHEN tc THEN 'bad_call' WHEN plain THEN 'untagged' ELSE 'think' END AS kind, CASE WHEN an THEN body || '<answer>' || ({sql_answer_text('o')}) || '</answer>' ELSE body END AS assistant,
  CASE WHEN an THEN NULL WHEN good THEN '<tool_response>' || array_to_string(list_transform(calls, lambda x, i: 'From: ' || coalesce(json_extract_string(x, '$.name'), 'tool_call') || chr(10) || coalesce(res[i], '')), '') || '</tool_response>'
    WHEN tc THEN 'Error decoding JSON in <tool_call>: ' || o WHEN plain THEN '{convert.NO_TOOL}' ELSE '{convert.WRONG_FORMAT}' END AS user FROM t""")
def trace_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an output of several forms; what the tools found is the next turn."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("results", F.array(F.coalesce(following, F.lit("")), F.concat(F.lit("page "), "turn")))
    return rows.select("conv_id", "turn", convert.traced_turn(F.expr(_output(JSON_TEXT)), F.col("results")).alias("t")).select("conv_id", "turn", "t.*")


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS num_tool_calls, count(*)::BIGINT AS steps, md5(string_agg(text || substring(text, 1, 32000), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("thinking"), F.col("text").alias("response"), (F.col("role") == "assistant").alias("is_call"))
    return longs(convert.rolled_up(steps, "conv_id", "turn").select("conv_id", "num_tool_calls", F.size("steps").alias("steps"), F.md5("trace").alias("digest")))


#: Outputs whose last tag isn't closed, or is, around whole turns.
HALF_CALL = """CASE (conv_id + turn) % 4 WHEN 0 THEN '<think>' || text || '</think> <tool_call>{"name":"' || role || '"} ' WHEN 1 THEN ' <tool_call>' || text WHEN 2 THEN text || ' <tool_call>{}' ELSE '<think>' || text || '</think><tool_call>{}</tool_call>' END"""
HALF_ANSWER = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'so <answer>' || text || ' </answer>' WHEN 1 THEN '<answer> ' || text WHEN 2 THEN text ELSE '<answer>' || role || '</answer><answer>' || text || '</answer>' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {HALF_CALL} AS b, {sql_strip(HALF_CALL)} AS s, {HALF_ANSWER} AS g FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with({sql_strip("split_part(s, '</think>', -1)")}, '<tool_call>') AND NOT ends_with(s, '>') THEN s || '</tool_call>' ELSE b END AS closed,
  '<answer>' || CASE WHEN contains(g, '<answer>') THEN ({sql_answer_text('g')}) ELSE g END || '</answer>' AS forced FROM r""")
def trace_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without their closing tag, and forced answers."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", convert.closed_call(F.expr(HALF_CALL)).alias("closed"), convert.forced_answer(F.expr(HALF_ANSWER)).alias("forced"))


# run totals


@query("""SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 0)::BIGINT AS rejected, count(DISTINCT quality + 2 * toxic)::BIGINT AS kinds, round(avg(toxic), 6) AS avg_toxic FROM labels""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_distinct(F.col("quality") + 2 * F.col("toxic")).alias("kinds"), F.round(F.avg("toxic"), 6).alias("avg_toxic"))


@query("""SELECT error, count(*)::BIGINT AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'too short' WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END AS error FROM documents) WHERE error IS NOT NULL GROUP BY error""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("n_chars") < 100, "too short").when(F.rlike("text", F.lit("[0-9]{4}")), "digits")
    return table(spark, sf_dir, "documents").select(error.alias("error")).filter("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS day_ms, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of events: the batch form of what the stream counts. Not part of the reference."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", F.unix_millis(F.col("day").cast("timestamp")).alias("day_ms"), "n")


# the rest of the small operators


@query("SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN text || '\u4e2d' ELSE text END, '[\u4e00-\u9fff]') AS cjk FROM documents")
def cjk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\u4e2d"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.has_cjk(text).alias("cjk"))


@query(f"""WITH {TAGGED_SQL}, m AS (SELECT conv_id, pos, role, replace(replace(content, 'visit', 'open_url'), '<think>second', '<think>2nd') AS c FROM tg),
q AS (SELECT conv_id, list('{{"content": ' || {sql_json('c')} || ', "role": ' || {sql_json('role')} || '}}' ORDER BY pos) AS m FROM m GROUP BY conv_id)
SELECT conv_id, sha256('[' || array_to_string(m, ', ') || ']') AS digest FROM q WHERE contains(m[1], 'Input Question')""")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that ask in the expected form, with names replaced, by the hash of their messages."""
    rows = conversations(tagged_turns(spark, sf_dir))
    made = T.renamed(F.col("messages"), {"visit": "open_url", "<think>second": "<think>2nd"})
    return rows.filter(T.asks_question(F.col("messages"))).select("conv_id", T.message_hash(made).alias("digest"))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, 'Title: d' || doc_id || chr(10) || 'URL: u/' || doc_id || chr(10) || 'Snippet: ' || text AS s FROM documents)
SELECT lang, md5(string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM r WHERE k <= 3 GROUP BY lang""")
def result_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of a language as a page of results; each task passes on three at most."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")))
    item = F.struct("doc_id", F.concat(F.lit("d"), "doc_id").alias("title"), F.concat(F.lit("u/"), "doc_id").alias("url"), F.col("text").alias("snippet"))
    rows = docs.filter("k <= 3").groupBy("lang").agg(F.sort_array(F.collect_list(item)).alias("r"))
    return rows.select("lang", F.md5(T.rendered_results(F.col("r"))).alias("digest"))


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)
SELECT label::BIGINT AS label, string_agg('Title: v' || vec_id || chr(10) || 'Source: ' || CASE WHEN vec_id % 2 = 0 THEN 'site' ELSE '' END || chr(10) || 'URL: u/' || vec_id || chr(10) || 'Image: i/' || vec_id || '.png', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY vec_id) AS made FROM r WHERE k <= 4 GROUP BY label""")
def image_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four vectors of a label as a page of image results."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("k <= 4")
    named = lambda head, tail="": F.concat(F.lit(head), F.col("vec_id"), F.lit(tail))
    item = F.struct("vec_id", named("v").alias("title"), F.when(F.col("vec_id") % 2 == 0, "site").alias("source"), named("u/").alias("link"), named("i/", ".png").alias("imageUrl"))
    return rows.groupBy(F.col("label").cast("long").alias("label")).agg(T.rendered_images(F.sort_array(F.collect_list(item)), 4).alias("made"))


@query("SELECT doc_id, md5(CASE WHEN len(text) > 2000 THEN substring(text, 1, 2000) || chr(10) || chr(10) || '[cut]' ELSE text END) AS digest FROM documents")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncated(F.col("text"), 2000, "\n\n[cut]")).alias("digest"))


@query("""WITH r AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_filter(r, lambda x: x = 'assistant'))::BIGINT AS trained, least(1, len(list_filter(r, lambda x: x = 'assistant')))::BIGINT AS trained_last, len(r)::BIGINT AS trained_all,
  array_to_string(list_transform(range(1, least(len(r), 3) + 1), lambda i: i), ',') AS cut FROM r""")
def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are trained on under each option, and ids up to a cutoff."""
    rows = conversations(table(spark, sf_dir, "conversations")).withColumn("r", F.transform("messages", lambda m: m["role"]))
    n = lambda mask: F.size(F.filter(mask, lambda x: x)).cast("long")
    r = F.col("r")
    ids = F.transform(F.sequence(F.lit(1), F.size("r")), lambda x: x.cast("string"))
    return rows.select("conv_id", n(T.label_mask(r)).alias("trained"), n(T.label_mask(r, mask_history=True)).alias("trained_last"), n(T.label_mask(r, train_on_prompt=True)).alias("trained_all"), F.array_join(T.cut_ids(ids, 4, packing=True), ",").alias("cut"))


@query("SELECT round(sum(len(text)) * 3.0::DOUBLE / 120.0, 4) AS tps, count(*)::BIGINT AS n FROM documents")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters a second of three passes in two minutes."""
    return table(spark, sf_dir, "documents").agg(F.round(stats.throughput(F.length("text"), 3.0, 120.0), 4).alias("tps"), F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x) * 40)::INT % 4) AS m FROM embeddings)
SELECT vec_id, coalesce(array_to_string(list_filter(range(0, len(m)), lambda i: m[i + 1] <> 0), ','), '') AS places FROM m""")
def unpadded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("embedding", lambda x: (_scaled(x, 40) % 4).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(stats.unpadded(mask), lambda i: i.cast("string")), ",").alias("places"))
