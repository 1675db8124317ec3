"""Edits of conversations: eviction and merging of rounds, with the images that go along.

All of it is row-wise on ``messages`` (an array of role and content). Round r has
its assistant turn at 2r - 3 and its user turn at 2r - 2 (from 0; no system
message); round 1 is the question at 0. An evicted or merged-away turn is null
until ``compact`` drops it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.functions import text as T


def slots_of(rounds: Column, n: Column) -> Column:
    """Message indices of some rounds of a conversation of n messages; rounds beyond 2 to the last are ignored."""
    both = F.flatten(F.transform(rounds, lambda r: F.when(r >= 2, F.array(2 * r - 3, 2 * r - 2)).otherwise(F.array().cast("array<int>"))))
    return F.filter(both, lambda i: i < n)


def evicted(messages: Column, rounds: Column) -> Column:
    """The turns of the given rounds set to null."""
    drop = slots_of(rounds, F.size(messages))
    return F.transform(messages, lambda m, i: F.when(~F.array_contains(drop, i), m))


def compact(messages: Column) -> Column:
    return F.filter(messages, lambda m: m.isNotNull())


def _fold(contents: Column, merge) -> Column:
    return F.aggregate(F.slice(contents, F.lit(2), F.greatest(F.size(contents) - 1, F.lit(0))), F.get(contents, F.lit(0)), merge)


def _gathered(contents: Column, assistant: bool) -> Column:
    """All parts collected before one canonical turn is built."""
    if not assistant:
        return T.user_text(F.flatten(F.transform(contents, T.responses)))
    parts = [F.flatten(F.transform(contents, f)) for f in (T.thinks, T.calls, T.answers)]
    return T.assistant_text(*parts)


def all_thinks(contents: Column) -> Column:
    """The thoughts of several turns that have something in them."""
    return F.filter(F.flatten(F.transform(contents, T.thinks)), lambda t: t != "")


def joined_thinks(contents: Column) -> Column:
    """All thoughts of several turns, joined: what is rephrased, and what its hash is looked up by."""
    return F.array_join(all_thinks(contents), T.JOIN_THINKS)


def _rephrased(turn: Column, joined: Column, by: Column) -> Column:
    """A gathered turn with its joined thoughts replaced by what a map has for them."""
    return T.let(F.struct(turn.alias("t"), joined.alias("j")), lambda x: F.concat(F.lit("<think>"), F.coalesce(F.element_at(by, x["j"]), x["j"]), F.substring(x["t"], F.length(x["j"]) + 8, F.length(x["t"]))))


def merged(messages: Column, groups: Column, pairwise: bool = True, rephrased: Column | None = None, listed: Column | None = None) -> Column:
    """Rounds of each group merged into its first; the turns of the others become null.

    ``groups`` is an array of ascending round numbers per group. ``pairwise`` merges one
    round after the other, so that the note on several responses is put on once per step, and what has no partner stays as it is;
    else all parts are gathered first, and the first turns of a group are built anew from what there is. ``rephrased`` is a map from joined
    thoughts, two or more, to what replaces them (gathered merging only); what isn't in it stays.

    ``listed`` says of each message whether its content is a list of parts, which can't be merged. Pairwise, a turn like that
    stays, and so do all turns that would go into one. Gathered, it gives nothing and goes like others.
    """
    n = F.size(messages)
    groups = F.filter(groups, lambda g: (F.size(g) > 1) & ~F.array_contains(g, 1))
    is_list = lambda k: F.lit(False) if listed is None else F.coalesce(F.get(listed, k), F.lit(False))
    stays = lambda first, k: is_list(k) | is_list(first) if pairwise else F.lit(False)

    def gone(g: Column) -> Column:
        first = F.get(g, F.lit(0))
        pairs = lambda r: F.array(F.struct((2 * first - 3).alias("first"), (2 * r - 3).alias("k")), F.struct((2 * first - 2).alias("first"), (2 * r - 2).alias("k")))
        return F.filter(F.flatten(F.transform(F.slice(g, F.lit(2), F.size(g) - 1), pairs)), lambda p: (p["k"] < n) & ~stays(p["first"], p["k"]))

    removed = F.transform(F.flatten(F.transform(groups, gone)), lambda p: p["k"])

    def turn(m: Column, i: Column) -> Column:
        r = F.floor((i + 3) / 2).cast("int")
        mine = F.get(F.filter(groups, lambda g: (F.get(g, F.lit(0)) == r) & (i > 0)), F.lit(0))
        assistant = i % 2 == 1
        at = F.filter(F.transform(mine, lambda q: F.when(assistant, 2 * q - 3).otherwise(2 * q - 2)), lambda k: (k < n) & F.get(messages, k).isNotNull() & ~is_list(k))

        def joined(contents: Column) -> Column:
            if pairwise:
                one, two = _fold(contents, T.merge_assistant), _fold(contents, T.merge_user)
                return F.when((F.size(contents) < 2) | is_list(i), m["content"]).when(assistant, one).otherwise(two)
            one, two = _gathered(contents, True), _gathered(contents, False)
            if rephrased is not None:
                one = F.when(F.size(all_thinks(contents)) > 1, _rephrased(one, joined_thinks(contents), rephrased)).otherwise(one)
            return F.when(assistant, one).otherwise(two)

        content = T.let(F.transform(at, lambda k: F.coalesce(F.get(messages, k)["content"], F.lit(""))), joined)
        return F.when(F.array_contains(removed, i), None).when(mine.isNotNull() & m.isNotNull(), F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(m)

    return F.transform(messages, turn)


def is_listed(content: Column) -> Column:
    """Whether a content (VARIANT) is a list of parts and not a text."""
    return F.coalesce(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), F.lit(False))


def as_texts(messages: Column) -> Column:
    """Messages with VARIANT contents as messages with texts, for statistics, evidence and all else that reads texts only; a list is null."""
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.variant_get(c, "$", "string"))
    return F.transform(messages, lambda m: F.when(m.isNotNull(), F.struct(m["role"].alias("role"), text(m["content"]).alias("content"))))


def merged_parts(messages: Column, groups: Column, pairwise: bool = True, rephrased: Column | None = None) -> Column:
    """``merged`` of messages whose contents are VARIANT: a text or a list of parts. Lists that stay are as they were."""

    def made(x: Column) -> Column:
        new = merged(x["texts"], groups, pairwise, rephrased, x["listed"])
        whole = lambda m, i: F.when(m.isNotNull(), F.struct(m["role"].alias("role"), F.when(m["content"].isNotNull(), m["content"].cast("variant")).otherwise(F.get(messages, i)["content"]).alias("content")))
        return F.transform(new, whole)

    listed = F.transform(messages, lambda m: is_listed(m["content"]))
    return T.let(F.struct(as_texts(messages).alias("texts"), listed.alias("listed")), made)


def images_by_message(messages: Column, images: Column) -> Column:
    """A flat list of images dealt out to messages by their image tokens; null if the numbers differ."""
    return F.when(image_count(messages) == F.size(images), dealt_images(messages, images))


def image_count(messages: Column) -> Column:
    """Image tokens of all messages."""
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.coalesce(T.count_images(m["content"]), F.lit(0)))


def dealt_images(messages: Column, images: Column) -> Column:
    """The same as far as the images go, whatever their number."""
    counts = F.transform(messages, lambda m: F.coalesce(T.count_images(m["content"]), F.lit(0)))

    def dealt(counts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, b: a + b)
        return F.transform(counts, lambda n, i: F.slice(images, before(i) + 1, n))

    return T.let(counts, dealt)


def images_rejoined(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``images`` and ``state`` for edited conversations, from their sources by the hash of the original messages.

    ``rows`` has ``original`` and ``messages`` (as they are now) and ``removed`` (rounds); ``source`` has ``messages``,
    ``images`` and ``ord``: of equal messages the last one's images count. Images of removed rounds go. The state is ``no_original``, ``unmatched``,
    ``mismatch`` (other tokens than images) or ``ok``.
    """
    last = source.select(T.message_hash(F.col("messages")).alias("__hash"), "images", "ord").groupBy("__hash").agg(F.max_by("images", "ord").alias("__images"), F.lit(True).alias("__there"))
    both = rows.withColumn("__hash", F.when(F.size("original") > 0, T.message_hash(F.col("original")))).join(last, "__hash", "left")
    kept = kept_images(dealt_images(F.col("original"), F.coalesce("__images", F.array().cast("array<string>"))), slots_of(F.col("removed"), F.size("original")))
    both = both.withColumn("images", F.when(F.col("__there") & F.col("__images").isNotNull(), kept))
    state = (
        F.when(F.col("__hash").isNull(), "no_original")
        .when(F.col("images").isNull(), "unmatched")
        .when(image_count(F.col("messages")) != F.size("images"), "mismatch")
        .otherwise("ok")
    )
    return both.withColumn("state", state).drop("__hash", "__images", "__there")


def all_rejoined(rows: DataFrame) -> DataFrame:
    """``rows`` of ``images_rejoined``; an error if one has found no images, or other ones than its tokens say."""
    bad = rows.filter("state IN ('no_original', 'unmatched', 'mismatch')").groupBy("state").count().collect()
    if bad:
        raise ValueError("images don't fit: " + ", ".join(f"{r['count']} {r['state']}" for r in sorted(bad)))
    return rows


def rephrased_by(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``rows`` (``conv_id, messages, groups``) with ``rephrased``: joined thoughts of their groups and what a cache has for them.

    ``cache`` has ``key`` (SHA-256 of joined thoughts) and ``value``. What it lacks isn't in the map, and so stays.
    """
    contents = lambda g: F.filter(F.transform(g, lambda q: F.get(F.col("messages"), 2 * q - 3)["content"]), lambda c: c.isNotNull())
    asked = rows.select("conv_id", F.explode(F.array_distinct(F.transform("groups", lambda g: joined_thinks(contents(g))))).alias("joined"))
    found = asked.withColumn("key", F.sha2("joined", 256)).join(cache.select("key", "value"), "key")
    maps = found.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("joined", "value"))).alias("rephrased"))
    none = F.create_map().cast("map<string,string>")
    return rows.join(maps, "conv_id", "left").withColumn("rephrased", F.coalesce("rephrased", none))


def thoughts(rows: DataFrame) -> DataFrame:
    """``key, joined``: the distinct joined thoughts of all groups of ``rows`` (``messages, groups``) that have two or more, with their SHA-256."""
    contents = lambda g: F.filter(F.transform(g, lambda q: F.get(F.col("messages"), 2 * q - 3)["content"]), lambda c: c.isNotNull())
    groups = F.filter("groups", lambda g: (F.size(g) > 1) & ~F.array_contains(g, 1))
    several = F.filter(F.transform(groups, contents), lambda c: F.size(all_thinks(c)) > 1)
    asked = rows.select(F.explode(F.transform(several, joined_thinks)).alias("joined"))
    return asked.distinct().select(F.sha2("joined", 256).alias("key"), "joined")


def asked(distinct: DataFrame, call: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """``key, value``: what a rephraser makes of each thought; thoughts for which it fails have no row.

    The callable is handed lists of at most ``batch`` texts and gives as many back, which are stripped. If it raises, gives another number, or one that isn't a
    text, the thoughts of that list are asked one by one, and those that fail alone are left out: the plain join takes their place.
    """

    def one_by_one(texts: list[str]) -> list[str | None]:
        found = []
        for text in texts:
            try:
                answer = list(call([text]))
            except Exception:  # whatever a rephraser raises, the row is kept as it is
                answer = [None]
            found.append(answer[0].strip() if len(answer) == 1 and isinstance(answer[0], str) else None)
        return found

    def answers(texts: list[str]) -> list[str | None]:
        try:
            found = list(call(texts))
        except Exception:
            return one_by_one(texts)
        good = len(found) == len(texts) and all(isinstance(a, str) for a in found)
        return [a.strip() for a in found] if good else one_by_one(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                made = pd.DataFrame({"key": part["key"].to_numpy(), "value": pd.Series(answers(part["joined"].tolist()), dtype="object").to_numpy()})
                yield made[made["value"].notna()]

    return distinct.mapInPandas(run, "key string, value string")


def rephrased_with(rows: DataFrame, call: Callable[[list[str]], list[str]], path: str, batch: int = 16, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``rephrased``, for ``merged``, by a callable whose answers are kept at ``path``.

    A thought is asked once, however many groups have it and however often this is called: answers are written to the cache before they are used,
    and only thoughts that it lacks are asked. ``tasks`` is how many calls may run at a time.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.createDataFrame([], "key string, value string")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    cache = spark.read.schema(known.schema).parquet(path) if there else known
    new = thoughts(rows).join(cache.select("key"), "key", "left_anti")
    asked(new.repartition(tasks, "key") if tasks else new, call, batch).write.mode("append").parquet(path)
    return rephrased_by(rows, spark.read.schema(known.schema).parquet(path))


def merged_images(dealt: Column, groups: Column) -> Column:
    """Images of merged rounds moved to the first round of their group, per slot."""
    n = F.size(dealt)
    groups = F.filter(groups, lambda g: (F.size(g) > 1) & ~F.array_contains(g, 1))
    none = F.array().cast("array<string>")

    def slot(mine: Column, i: Column) -> Column:
        r = F.floor((i + 3) / 2).cast("int")
        group = F.get(F.filter(groups, lambda g: F.array_contains(g, r) & (i > 0)), F.lit(0))
        at = F.filter(F.transform(group, lambda q: F.when(i % 2 == 1, 2 * q - 3).otherwise(2 * q - 2)), lambda k: k < n)
        joined = F.flatten(F.transform(at, lambda k: F.get(dealt, k)))
        return F.when(group.isNull(), mine).when(F.get(group, F.lit(0)) == r, joined).otherwise(none)

    return F.transform(dealt, slot)


def kept_images(dealt: Column, drop: Column) -> Column:
    """The flat list of the images whose messages stay."""
    return F.flatten(F.filter(dealt, lambda x, i: ~F.array_contains(drop, i)))


def evidence(messages: Column) -> Column:
    """What users and the system said, in lower case."""
    said = F.filter(messages, lambda m: m["role"].isin("user", "system"))
    return F.lower(F.array_join(F.transform(said, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"))


def lost_tokens(new: Column, old: Column) -> Column:
    """Up to five tokens of the final answer and thought that only dropped evidence had, sorted."""

    def lost(m: Column) -> Column:
        final = F.coalesce(F.get(m, F.size(m) - 1)["content"], F.lit(""))
        answer, think = (F.get(F.regexp_extract_all(final, F.lit(T.tag_pattern(tag)), F.lit(1)), F.lit(0)) for tag in ("answer", "think"))
        said = F.concat(F.coalesce(F.concat(answer, F.lit("\n")), F.lit("")), F.coalesce(think, F.lit("")))
        known = F.struct(evidence(m).alias("now"), evidence(old).alias("then"))
        return T.let(known, lambda e: F.filter(T.grounding_tokens(said), lambda t: ~F.contains(e["now"], F.lower(t)) & F.contains(e["then"], F.lower(t))))

    return F.slice(F.array_sort(T.let(new, lost)), 1, 5)


def planned(messages: Column, start: Column, middle: Column, remove: Column, patches: Column) -> Column:
    """Messages after a plan: thoughts of kept rounds patched, then the rounds to remove dropped."""
    n = F.size(messages)
    gone = F.filter(remove, lambda r: (r >= 2) & (r <= middle + 1))
    drop = F.flatten(F.transform(gone, lambda r: F.array(start + 2 * r - 3, start + 2 * r - 2)))

    def patched(m: Column, i: Column) -> Column:
        r = F.when(i == n - 1, middle + 2).when(((i - start) % 2 == 1) & (i - start < 2 * middle), F.floor((i - start + 3) / 2).cast("int"))
        new = F.when(r.isNotNull(), F.element_at(patches, F.coalesce(r, F.lit(0))))
        return F.struct(m["role"].alias("role"), F.when(new.isNotNull(), T.replace_think(F.coalesce(m["content"], F.lit("")), T.strip(new))).otherwise(m["content"]).alias("content"))

    return F.filter(F.transform(messages, patched), lambda m, i: ~F.array_contains(drop, i))


def critical_path(rows):
    """The state machine of critical-path deletion over rows of ``messages``, ``start``,
    ``middle``, ``malformed`` and a plan (``plan_status, remove, patches``).

    Adds ``status``, ``reason`` and ``messages_new``; rows that aren't reduced keep their messages.
    ``plan_status`` is null where no plan could be read.
    """
    m, middle = F.col("messages"), F.col("middle")
    gone = F.filter("remove", lambda r: (r >= 2) & (r <= middle + 1))
    rows = rows.withColumn("__made", planned(m, F.col("start"), middle, F.col("remove"), F.col("patches")))
    made, lost = F.col("__made"), F.col("__lost")
    rows = rows.withColumn("__lost", lost_tokens(made, m))
    last = F.get(made, F.size(made) - 1)["role"]
    known = F.col("plan_status").isin("reduce", "non_reducible", "illogical")
    def told(status: Column, reason: Column) -> Column:
        return F.struct(status.alias("col1"), reason.alias("col2"))

    state = (
        F.when(F.size(m) < 3, told(F.lit("no_messages"), F.lit("")))
        .when(F.col("malformed"), told(F.lit("bad_structure"), F.lit("")))
        .when(middle == 0, told(F.lit("non_reducible"), F.lit("no_middle_rounds")))
        .when(F.col("plan_status").isNull(), told(F.lit("parse_json"), F.lit("")))
        .when(~known, told(F.lit("bad_status"), F.col("plan_status")))
        .when(F.col("plan_status") != "reduce", told(F.col("plan_status"), F.lit("")))
        .when(F.size(F.array_distinct(gone)) >= middle, told(F.lit("skipped"), F.lit("remove_all_middle")))
        .when(F.coalesce(last != "assistant", F.lit(True)), told(F.lit("skipped"), F.lit("final_not_assistant")))
        .when(F.size(lost) > 0, told(F.lit("non_reducible"), F.concat(F.lit("grounding_loss:"), F.array_join(lost, ","))))
        .otherwise(told(F.lit("reduce"), F.lit("")))
    )
    rows = rows.withColumn("__state", state)
    status = F.col("__state.col1")
    return rows.withColumn("status", status).withColumn("reason", F.col("__state.col2")).withColumn("messages_new", F.when(status == "reduce", made).otherwise(m)).drop("__state", "__made", "__lost")
