"""Statistics of conversations, lengths and scores, as plain aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roundweave.functions import text as T


def message_stats(messages: Column) -> Column:
    """(n_msgs, think_chars, total_chars) of a conversation; nulls are passed over."""
    length = lambda s: F.coalesce(F.length(s), F.lit(0))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, b: a + b)
    thoughts = F.transform(messages, lambda m: total(F.transform(F.regexp_extract_all(F.coalesce(m["content"], F.lit("")), F.lit(T.tag_pattern("think")), F.lit(1)), length)))
    return F.struct(F.size(messages).alias("n_msgs"), total(thoughts).alias("think_chars"), total(F.transform(messages, lambda m: length(m["content"]))).alias("total_chars"))


def percent_less(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(100.0 * (before - after) / before)


def reduction_summary(rows: DataFrame) -> DataFrame:
    """One row of averages, reductions and savings from (n_before, n_after, chars_before, chars_after)."""
    saved = F.col("n_before") - F.col("n_after")
    some = F.when(saved > 0, saved)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("samples"),
        F.round(F.avg("n_before"), 4).alias("avg_before"),
        F.round(F.avg("n_after"), 4).alias("avg_after"),
        F.round(percent_less(F.sum("n_before"), F.sum("n_after")), 4).alias("msg_reduction"),
        F.round(percent_less(F.sum("chars_before"), F.sum("chars_after")), 4).alias("char_reduction"),
        F.count(some).alias("affected"),
        F.round(100.0 * F.count(some) / n, 4).alias("affected_pct"),
        F.median(some).cast("double").alias("median_saved"),
        F.max(some).cast("long").alias("max_saved"),
    )


def largest_savings(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows that saved most messages, most first; ties by key."""
    return rows.select(key, (F.col("n_before") - F.col("n_after")).alias("saved")).filter("saved > 0").orderBy(F.desc("saved"), key).limit(k)


def histogram(rows: DataFrame, value: Column, width: int, name: str = "bucket") -> DataFrame:
    return rows.groupBy((F.floor(value / width) * width).cast("long").alias(name)).agg(F.count(F.lit(1)).alias("n"))


def cumulative(hist: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Running counts and shares over a histogram. The window runs over buckets, which are few."""
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cum", F.sum("n").over(upto)).withColumn("cum_pct", F.round(100.0 * F.col("cum") / F.sum("n").over(Window.partitionBy()), 4))


def accuracy_by(rows: DataFrame, group: str, correct: str) -> DataFrame:
    """Accuracy of each group and of all (``Average``), in percent."""
    sets = rows.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).alias("g"), F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(correct), 4).alias("accuracy"))
    return sets.select(F.when(F.col("g") == 1, "Average").otherwise(F.col(group)).alias("category"), "n", "accuracy")


def sequence_offsets(mask: Column) -> Column:
    """Where the sequences packed in a mask (1, 2, ... and 0 for padding) begin among its places without padding, and their end; one pass after a sort."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        own = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(last >= 0, F.concat(own, F.array(last + 1))).otherwise(F.array(F.lit(0)))

    return T.let(F.sort_array(F.filter(mask, lambda x: x > 0)), starts)


def sequence_lengths(mask: Column) -> Column:
    """Lengths of the sequences packed in a mask, in order."""
    return T.let(sequence_offsets(mask), lambda o: F.transform(F.slice(o, F.lit(2), F.size(o) - 1), lambda end, i: end - F.get(o, i)))


def running_offsets(lengths: Column) -> Column:
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def masked_accuracy(predicted: Column, labels: Column, ignored: int = -100) -> Column:
    """Share of labels met by the prediction one place before, of those not ignored."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    hits = F.zip_with(F.slice(predicted, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda p, l: F.when(l != ignored, F.coalesce(p == l, F.lit(False))))
    counted = F.filter(hits, lambda x: x.isNotNull())
    return T.let(counted, lambda c: F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: x)) / F.size(c)))


def unpadded(mask: Column) -> Column:
    """Places of a mask that aren't padding."""
    return F.filter(F.transform(mask, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def throughput(tokens: Column, epochs: float, seconds: float) -> Column:
    """Effective tokens a second."""
    return F.sum(tokens) * epochs / seconds


#: Floating-point operations a second of devices at half precision (fixed values).
DEVICE_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "V100": 125e12, "4090": 98e12}


def model_flops(config: Column, batch: Column, length: Column, backward: bool = True, recompute: bool = False, flash_attention: bool = False) -> Column:
    """Floating-point operations of a training step of a decoder of some shape.

    ``config`` is a struct (hidden, vocab, intermediate, heads, kv_heads, layers, tied). Twice a product counts as one multiplication and one addition.
    In doubles, as the numbers pass 2^63.
    """
    part = lambda name: config[name].cast("double")
    hidden, batch, length = part("hidden"), batch.cast("double"), length.cast("double")
    mlp = 3 * 2 * hidden * part("intermediate")
    grouped = F.floor(2 * hidden * hidden * part("kv_heads") / part("heads")).cast("double")
    projections = 2 * (2 * hidden * hidden) + 2 * grouped
    scores = 2 * 2 * hidden * length * length * batch * part("layers")
    inner = batch * length * part("layers") * (mlp + projections) + scores
    embedding = batch * length * hidden * part("vocab") * F.when(config["tied"], 1.0).otherwise(2.0)
    total = (1 + 2 * backward + recompute) * inner + (1 + 2 * backward) * embedding
    return total + scores if flash_attention else total


def device_flops(name: Column, devices: Column) -> Column:
    """What so many devices can do a second, by their name; an error for one that isn't known."""
    known = F.lit(None).cast("double")
    for device, flops in reversed(DEVICE_FLOPS.items()):
        known = F.when(F.contains(name, F.lit(device)), flops).otherwise(known)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no device like "), F.coalesce(name, F.lit("null")))).cast("double")) * devices


def utilisation(steps_a_second: Column, step_flops: Column, available: Column) -> Column:
    """The share of what the devices can do that a training run uses."""
    return steps_a_second * step_flops / available


def smoothed(values: Column) -> Column:
    """Exponential smoothing whose weight is a sigmoid of the length."""
    weight = F.lit(1.8) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-0.05 * F.size(values))) - 0.5)
    first = F.get(values, F.lit(0))
    start = F.struct(first.alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["last"] * weight + (1 - weight) * x
        return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _ngrams(items: list, n: int) -> dict:
    found: dict = {}
    for i in range(len(items) - n + 1):
        key = tuple(items[i : i + n])
        found[key] = found.get(key, 0) + 1
    return found


def bleu4(predicted: str, label: str) -> float:
    """Sentence BLEU-4 over characters; an order without matches counts half as much as the one before it."""
    if not predicted or not label:
        return 0.0
    log_sum, misses = 0.0, 1

    for n in range(1, 5):
        ours, theirs = _ngrams(list(predicted), n), _ngrams(list(label), n)
        hits = sum(min(c, theirs.get(g, 0)) for g, c in ours.items())
        total = max(1, len(predicted) - n + 1)
        if n == 1 and hits == 0:
            return 0.0
        if hits == 0:
            share = 1 / (2**misses * total)
            misses += 1
        else:
            share = hits / total
        log_sum += 0.25 * log(share)
    brevity = 1.0 if len(predicted) > len(label) else exp(1 - len(label) / len(predicted))
    return brevity * exp(log_sum)


def rouge_f(predicted: list[str], label: list[str], n: int) -> float:
    """ROUGE-n F1 over sets of n-grams."""
    ours, theirs = set(_ngrams(predicted, n)), set(_ngrams(label, n))
    if not ours or not theirs:
        return 0.0
    hits = len(ours & theirs)
    return 2 * hits / (len(ours) + len(theirs))


def common_length(one: list[str], two: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one number."""
    where: dict[str, int] = {}
    for j, b in enumerate(two):
        where[b] = where.get(b, 0) | 1 << j
    full = (1 << len(two)) - 1
    row = full
    for a in one:
        met = row & where.get(a, 0)
        row = ((row + met) | (row - met)) & full
    return len(two) - row.bit_count()


def rouge_l(predicted: list[str], label: list[str]) -> float:
    """ROUGE-L F1 by the longest common subsequence."""
    if not predicted or not label:
        return 0.0
    return 2 * common_length(predicted, label) / (len(predicted) + len(label))


def rouge(predicted: Column, label: Column, n: int) -> Column:
    """ROUGE-n F1 in percent over sets of n-grams of two token lists, in the JVM."""

    def grams(tokens: Column) -> Column:
        last = F.size(tokens) - n + 1
        return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(tokens, i, F.lit(n))))).otherwise(F.array().cast("array<array<string>>"))

    def score(x: Column) -> Column:
        total = F.size(x["p"]) + F.size(x["l"])
        return F.when((F.size(x["p"]) > 0) & (F.size(x["l"]) > 0), 200.0 * F.size(F.array_intersect(x["p"], x["l"])) / total).otherwise(0.0)

    return T.let(F.struct(grams(predicted).alias("p"), grams(label).alias("l")), score)


def patch_counts(rows: DataFrame) -> DataFrame:
    """One row on the reduced conversations: with patched thoughts at all, and with one of the final round or beyond.

    ``rows`` has ``status, patches`` (a map by round), ``n_before``, ``n_after`` and ``n_patched``.
    """
    reduced = F.col("status") == "reduce"
    final = F.greatest(F.lit(1), F.floor(F.col("n_before") / 2)) + 1
    last = F.coalesce(F.array_max(F.map_keys("patches")), F.lit(0))
    return rows.agg(
        F.count_if(reduced).alias("reduced"),
        F.count_if(reduced & (F.col("n_patched") > 0)).alias("patched"),
        F.count_if(reduced & (F.size("patches") > 0) & (last >= final)).alias("final_patched"),
        F.sum(F.when(reduced, F.col("n_before") - F.col("n_after"))).cast("long").alias("saved"),
    )


SCORES = StructType().add("bleu4", "double").add("rouge1", "double").add("rouge2", "double").add("rougel", "double")


@F.pandas_udf(SCORES)
def text_scores(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """BLEU-4 and ROUGE F1 in percent of (predicted, label). Tokens are split at white space."""
    for predicted, label in pairs:
        rows = []
        for p, q in zip(predicted.fillna(""), label.fillna("")):
            a, b = p.split(), q.split()
            rows.append([round(100 * x, 4) for x in (bleu4(p, q), rouge_f(a, b, 1), rouge_f(a, b, 2), rouge_l(a, b))])
        yield pd.DataFrame(rows, columns=["bleu4", "rouge1", "rouge2", "rougel"])
