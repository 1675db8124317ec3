"""Conversations as rows of nested messages, and their rounds.

Round 1 is the question, round r the assistant's turn and the user's (or tool's) turn
after it, the last round the final answer. One shuffle puts the messages of a
conversation together; all that follows is row-wise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversations(turns: DataFrame, content: Column | None = None) -> DataFrame:
    """``conv_id, messages`` (role, content in turn order) from rows with conv_id, turn, role, text."""
    content = F.col("text") if content is None else content
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", content.alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def start_of(messages: Column) -> Column:
    """Index of the question: a leading system message is passed over."""
    return F.when(F.get(messages, F.lit(0))["role"] == "system", 1).otherwise(0)


def n_middle(messages: Column) -> Column:
    """Middle rounds: pairs of assistant and user after the question, up to the first pair that isn't one."""
    start = start_of(messages)
    pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(messages) - start) / 2).cast("int")))

    def step(n: Column, k: Column) -> Column:
        a, u = start + 1 + 2 * k, start + 2 + 2 * k
        pair = (F.get(messages, a)["role"] == "assistant") & (F.get(messages, u)["role"] == "user")
        return F.when((n == k) & F.coalesce(pair, F.lit(False)), n + 1).otherwise(n)

    return F.aggregate(pairs, F.lit(0), step)


def is_malformed(messages: Column) -> Column:
    """No turn is left for the final answer, or the last turn isn't the assistant's."""
    past = start_of(messages) + 1 + 2 * n_middle(messages)
    return (past >= F.size(messages)) | F.coalesce(F.get(messages, F.size(messages) - 1)["role"] != "assistant", F.lit(True))


def with_rounds(rows: DataFrame) -> DataFrame:
    """``start``, ``middle`` (count of middle rounds), ``malformed`` and ``final_round`` beside the messages."""
    m = F.col("messages")
    return rows.withColumn("start", start_of(m)).withColumn("middle", n_middle(m)).withColumn("malformed", is_malformed(m)).withColumn("final_round", F.col("middle") + 2)


def rounds(rows: DataFrame) -> DataFrame:
    """One row per round of well-formed conversations: ``conv_id, round_id, kind, asst_idx, user_idx``."""
    start, middle = F.col("start"), F.col("middle")
    question = F.array(F.struct(F.lit(1).alias("round_id"), F.lit("question").alias("kind"), F.lit(None).cast("int").alias("asst_idx"), start.alias("user_idx")))
    pairs = F.when(middle > 0, F.transform(F.sequence(F.lit(0), middle - 1), lambda k: F.struct((k + 2).alias("round_id"), F.lit("middle").alias("kind"), (start + 1 + 2 * k).alias("asst_idx"), (start + 2 + 2 * k).alias("user_idx"))))
    final = F.array(F.struct(F.col("final_round").alias("round_id"), F.lit("final").alias("kind"), (F.size("messages") - 1).alias("asst_idx"), F.lit(None).cast("int").alias("user_idx")))
    every = F.concat(question, F.coalesce(pairs, F.array().cast("array<struct<round_id:int,kind:string,asst_idx:int,user_idx:int>>")), final)
    return with_rounds(rows).filter("NOT malformed").select("conv_id", F.inline(every))


def drop_messages(messages: Column, drop: Column) -> Column:
    """Messages without those at the given indices."""
    return F.filter(messages, lambda m, i: ~F.array_contains(drop, i))


def alternates(messages: Column) -> Column:
    """Whether roles are user, assistant, user, ... from the start."""
    expected = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    return F.forall(F.transform(messages, lambda m, i: F.coalesce(m["role"] == expected(i), F.lit(False))), lambda ok: ok)


def repair_roles(messages: Column) -> Column:
    """The messages if roles alternate, else what one deletion makes alternate; null if none does.

    Tried in order: of adjacent equal user turns the second, then the first; then
    every turn whose role isn't the expected one.
    """
    n = F.size(messages)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    twin = lambda i: (F.get(messages, i)["role"] == "user") & (F.get(messages, i + 1)["role"] == "user") & (F.get(messages, i)["content"] == F.get(messages, i + 1)["content"])
    doubled = F.flatten(F.transform(F.filter(at, lambda i: F.coalesce(twin(i), F.lit(False))), lambda i: F.array(i + 1, i)))
    expected = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    wrong = F.filter(at, lambda i: F.coalesce(F.get(messages, i)["role"] != expected(i), F.lit(True)))
    without = lambda i: F.filter(messages, lambda m, k: k != i)
    works = F.filter(F.concat(doubled, wrong), lambda i: alternates(without(i)))
    return F.when(alternates(messages), messages).when(F.size(works) > 0, without(F.get(works, F.lit(0))))
