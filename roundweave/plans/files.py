"""Queries that write what they derive from the tables, and read it back through the sources and sinks.

Their files are in a new folder of the shared one, and stay there for the result that reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave import sources, streaming
from roundweave.operators import graph
from roundweave.operators.rounds import conversations
from roundweave.plans.inputs import GRAPH_SQL, edited, longs, sql_assistant, sql_bodies, sql_responses, sql_thinks, sql_user, table
from roundweave.plans.tables import query
from roundweave.shared import new_folder

DOCUMENT = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("digest"))


def _lines(docs: DataFrame) -> DataFrame:
    """Documents as JSON lines, with a blank line behind every fifth."""
    return docs.select("doc_id", F.to_json(F.struct(*docs.columns)).alias("value")).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("value", F.lit("\n  "))).otherwise(F.col("value")).alias("value"))


#: Lines that are cut off, and lines with a text for the number.
CUT, UNFIT = "doc_id % 7 = 3", "doc_id % 11 = 2"


def _broken_lines(docs: DataFrame) -> DataFrame:
    told = docs.withColumn("n_chars", F.when(F.expr(UNFIT), F.lit("many")).otherwise(F.col("n_chars").cast("string")))
    fit = F.when(F.expr(UNFIT), F.to_json(F.struct(*told.columns))).otherwise(F.to_json(F.struct(*(F.col(c).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in told.columns))))
    return told.select(F.when(F.expr(CUT), F.substring(fit, F.lit(1), F.length(fit) - 1)).otherwise(fit).alias("value"))


@query("SELECT doc_id, source, lang, n_chars::BIGINT AS n_chars, sha256(text) AS digest FROM documents")
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through JSON lines with blank lines between; any bad line would be an error."""
    path = new_folder(spark, "lines")
    _lines(_documents(spark, sf_dir)).select("value").write.text(path)
    return _digest(sources.read_jsonl(spark, path, DOCUMENT))


@query(f"SELECT doc_id, source, lang, n_chars::BIGINT AS n_chars, sha256(text) AS digest FROM documents WHERE NOT ({CUT}) AND NOT ({UNFIT})")
def jsonl_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through JSON lines of which some are cut off and some don't fit; these are skipped."""
    path = new_folder(spark, "broken")
    _broken_lines(_documents(spark, sf_dir)).write.text(path)
    return _digest(sources.read_jsonl(spark, path, DOCUMENT, bad_lines="skip"))


@query(f"""SELECT 'whole' AS lines, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents
UNION ALL SELECT 'broken', CASE WHEN count(*) FILTER (WHERE ({CUT}) OR ({UNFIT})) > 0 THEN 0 ELSE count(*) END, CASE WHEN count(*) FILTER (WHERE ({CUT}) OR ({UNFIT})) > 0 THEN 0 ELSE sum(n_chars) END FROM documents""")
def jsonl_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of JSON lines; the one with bad lines is read as an empty one."""
    whole, broken = new_folder(spark, "whole"), new_folder(spark, "broken")
    docs = _documents(spark, sf_dir)
    _lines(docs).select("value").write.text(whole)
    _broken_lines(docs).write.text(broken)
    total = lambda name, path: sources.read_jsonl(spark, path, DOCUMENT, bad_lines="empty").agg(F.lit(name).alias("lines"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    return total("whole", whole).unionByName(total("broken", broken))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _idx, doc_id, sha256(text) AS digest FROM documents")
def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in the order of their ids from any order, and read back with the numbers of their lines."""
    path = new_folder(spark, "ordered")
    docs = _documents(spark, sf_dir)
    sources.write_ordered(docs.repartition("lang"), path, "doc_id")
    return sources.read_indexed(spark, path, DOCUMENT).select("_idx", "doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT doc_id AS _idx, n_chars::BIGINT AS n_chars, CASE WHEN n_chars % 3 = 0 THEN 'odd length: ' || n_chars END AS error FROM documents
UNION ALL SELECT item_id + 1000000000000, len(text), CASE WHEN len(text) % 3 = 0 THEN 'odd length: ' || len(text) END FROM benchmark""")
def error_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to a folder of results and one of errors, both read back."""
    good, bad = new_folder(spark, "good"), new_folder(spark, "bad")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_idx"), F.col("n_chars").cast("long").alias("n_chars"))
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000000).alias("_idx"), F.length("text").cast("long").alias("n_chars"))
    for rows in (docs, items):
        sources.write_with_errors(rows.withColumn("error", F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("odd length: "), "n_chars"))), good, bad)
    done = sources.read_jsonl(spark, good, "_idx bigint, n_chars bigint").withColumn("error", F.lit(None).cast("string"))
    failed = sources.read_jsonl(spark, bad, "_idx bigint, error string")
    return done.unionByName(failed.select("_idx", F.substring_index("error", ": ", -1).cast("long").alias("n_chars"), "error"))


@query(f"""WITH {GRAPH_SQL}, pc AS (SELECT conv_id, count(*) AS pruned FROM ev GROUP BY conv_id), mc AS (SELECT conv_id, count(DISTINCT label) AS merged FROM lb WHERE k > 1 GROUP BY conv_id)
SELECT cv.conv_id, coalesce(pruned, 0) AS pruned, coalesce(merged, 0) AS merged FROM cv LEFT JOIN pc ON pc.conv_id = cv.conv_id LEFT JOIN mc ON mc.conv_id = cv.conv_id WHERE coalesce(pruned, 0) > 0 OR coalesce(merged, 0) > 0""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning and merging did to the conversations that they changed, as written beside the results."""
    path = new_folder(spark, "changed")
    members = F.array_distinct(F.transform(graph.strict_groups(F.col("pruned")), lambda g: g["members"]))
    several = F.filter(members, lambda m: F.size(m) > 1)
    rows = edited(spark, sf_dir).withColumn("merged", F.size(several).cast("long")).select("conv_id", "merged", F.size("evict").cast("long").alias("gone")).withColumnRenamed("gone", "pruned")
    sources.write_changed(rows, path)
    return sources.read_jsonl(spark, path, "conv_id bigint, pruned bigint, merged bigint")


@query("""SELECT md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest, max(text) FILTER (WHERE role = 'system') AS system FROM conversations GROUP BY conv_id""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that training needs, as a folder of JSON lines."""
    path = new_folder(spark, "training")
    rows = conversations(table(spark, sf_dir, "conversations")).withColumn("images", F.array().cast("array<string>")).withColumn("plan", F.lit("not for training"))
    rows = rows.withColumn("system", F.get(F.filter("messages", lambda m: m["role"] == "system"), F.lit(0))["content"])
    sources.training_view(rows).write.json(path)
    back = sources.read_jsonl(spark, path, f"messages {sources.MESSAGES}, images array<string>, system string")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return back.select(F.md5(said).alias("digest"), "system")


@query("SELECT doc_id, 2 * n_chars::BIGINT AS n_chars FROM documents")
def replaced_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of results that is replaced as a whole, but not by a version in which rows have no match."""
    path = new_folder(spark, "results")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    sources.replace_if_clean(docs, docs.filter("doc_id IS NULL"), path)
    twice = docs.withColumn("n_chars", 2 * F.col("n_chars"))
    sources.replace_if_clean(twice, docs.filter("doc_id IS NULL"), path)
    try:
        sources.replace_if_clean(docs.withColumn("n_chars", F.lit(-1)), docs, path)
    except ValueError:
        pass  # refused, as it has to be
    return sources.read_jsonl(spark, path, "doc_id bigint, n_chars bigint")


@query("""SELECT unnest(['documents: ' || count(*), 'chars: ' || sum(n_chars)::BIGINT, 'longest: ' || max(n_chars)]) AS line FROM documents""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as text, a line for each figure."""
    path = new_folder(spark, "summary")
    rows = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    sources.write_summary(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""SELECT event_type, event_id % 3 AS step, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of three steps appended to a log, which is read as a whole."""
    path = new_folder(spark, "log")
    events = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 3).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    for step in range(3):
        log = sources.append_log(events.filter(F.col("step") == step), path)
    return log


@query("SELECT doc_id, source, lang, n_chars::BIGINT AS n_chars FROM documents")
def formats_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of the documents in four formats, each read as its folder's first file says."""
    docs = _documents(spark, sf_dir).drop("text")
    parts = []
    for i, (fmt, options) in enumerate({"parquet": {}, "orc": {}, "json": {}, "csv": {"header": True}}.items()):
        path = new_folder(spark, fmt)
        docs.filter(F.col("doc_id") % 4 == i).write.options(**options).format(fmt).save(path)
        read = sources.read_any(spark, path)
        parts.append(read.select(*(F.col(f.name).cast(f.dataType) if f.name in read.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS n FROM documents")
def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared documents that are kept at a path; whoever asks again is given what is there."""
    path = new_folder(spark, "prepared")
    docs = table(spark, sf_dir, "documents")
    sources.kept_as(docs.select("doc_id", F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("n")), path)
    return sources.kept_as(docs.select("doc_id", F.lit(-1).alias("n")), path)


@query(f"""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {sql_assistant(sql_thinks('text'), sql_bodies('text', 'tool_call'), sql_bodies('text', 'answer'))} ELSE {sql_user(sql_responses('text'))} END AS text FROM conversations""")
def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in canonical form, as a stream of files in several batches."""
    path = new_folder(spark, "stream")
    turns = longs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    turns.write.json(f"{path}/in")
    stream = streaming.canonical_turns(streaming.read_samples(spark, f"{path}/in", turns.schema, files_per_batch=16))
    streaming.write(stream, f"{path}/out", f"{path}/check").awaitTermination()
    return spark.read.schema(turns.schema).parquet(f"{path}/out")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of six hours, as a stream gives them out: the watermark is twelve hours behind the last event."""
    path = new_folder(spark, "events")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").cast("string").alias("ts"), "event_type", "value")
    events.write.json(f"{path}/in")
    rows = streaming.read_samples(spark, f"{path}/in", events.schema, files_per_batch=1 << 30).withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    counted = streaming.event_counts(rows, "ts", "12 hours", "6 hours").select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
    streaming.write(counted, f"{path}/out", f"{path}/check").awaitTermination()
    back = spark.read.schema(counted.schema).parquet(f"{path}/out")
    return back.withColumn("start", F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))
