"""Selection of rows: pages, indices, samples, what is left to do, splits and mixes of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: str, index: int, size: int = 2) -> DataFrame:
    """One page of rows in order."""
    return rows.orderBy(order).offset(index * size).limit(size)


def neighbours(index: int, total: int, size: int = 2) -> tuple[int, int]:
    """Page before and after, clamped."""
    return max(0, index - 1), min(index + 1, max(0, (total - 1) // size))


def positions(index: int | slice | list[int], n: int) -> list[int]:
    """Row positions that an int, slice or list selects; anything else is an error."""
    if isinstance(index, slice):
        return list(range(*index.indices(n)))
    for_all = [index] if isinstance(index, int) else index
    if not isinstance(for_all, list) or not all(isinstance(i, int) for i in for_all):
        raise ValueError(f"can't select by {type(index).__name__}")
    if any(not -n <= i < n for i in for_all):
        raise IndexError("position out of range")
    return [i + n if i < 0 else i for i in for_all]


def select(rows: DataFrame, key: str, index: int | slice | list[int], n: int) -> DataFrame:
    """Rows at positions of a dense ``key``, in the order asked for (``at``), repeats kept."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(a, p) for a, p in enumerate(positions(index, n))], "at long, __p long")
    return rows.join(wanted, rows[key] == wanted["__p"]).drop("__p")


#: Rows that are numbered together, about, and the most parts that a table is numbered in.
PART_ROWS = 1_000_000
MOST_PARTS = 1000


def numbered(rows: DataFrame, order: str, name: str = "position", by: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with their places from 0 in the order of a number (nulls first), within ``by`` if given.

    The table is cut at quantiles of the number, the rows of each part are counted, and places are found within parts, so
    no task holds more than a part. What comes to the driver is a count for each part and value of ``by``, which must be few.
    """
    parts = max(1, min(MOST_PARTS, -(-rows.count() // part_rows)))
    bounds = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    cuts = F.array(*map(F.lit, sorted(set(bounds or []))))
    part = F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col(order))), F.lit(0)) if bounds else F.lit(0)
    group = F.col(by) if by else F.lit(0)
    placed = rows.withColumn("__part", part).withColumn("__by", group)
    before: dict = {}
    starts = []
    for r in sorted(placed.groupBy("__by", "__part").count().collect(), key=lambda r: r["__part"]):
        starts.append((r["__by"], r["__part"], before.get(r["__by"], 0)))
        before[r["__by"]] = before.get(r["__by"], 0) + r["count"]
    schema = placed.select(F.col("__by").alias("__b"), F.col("__part").alias("__p"), F.lit(0).cast("long").alias("__start")).schema
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, schema))
    within = F.row_number().over(Window.partitionBy("__by", "__part").orderBy(order)) - 1
    both = placed.withColumn("__in", within).join(known, placed["__by"].eqNullSafe(known["__b"]) & (placed["__part"] == known["__p"]))
    return both.withColumn(name, F.col("__start") + F.col("__in")).drop("__part", "__by", "__b", "__p", "__start", "__in")


def _draw(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 for a key, from the first 52 bits of its digest."""
    return F.conv(F.substring(_digest(key, seed), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` in an order by chance, which the seed and the keys say, however the table is split: range-sorted by digests, so part by part and row by row.

    Rows with one key stand beside each other, in any order.
    """
    order = _digest(F.col(key), seed)
    return rows.withColumn("__order", order).repartitionByRange("__order", key).sortWithinPartitions("__order", key).drop("__order")


def buffer_place(number: Column, buffer: int, seed: int) -> Column:
    """Where a bounded buffer lets a row go: with a dense number i, somewhere from i to i + buffer - 1.

    Rows go in the order of this, and of ``buffer_order`` among those with one place; so at any time at most ``buffer`` rows are held back. It depends on the number and
    the seed only, so batches and streams give the same order on any split.
    """
    return number + F.floor(_draw(number, seed) * buffer)


def buffer_order(number: Column, buffer: int, seed: int) -> list[Column]:
    """What to sort by."""
    return [buffer_place(number, buffer, seed), _digest(number, seed)]


def buffer_shuffled(rows: DataFrame, key: str, buffer: int, seed: int) -> DataFrame:
    """``rows`` with a dense number ``key`` in the order of a shuffle with a bounded buffer."""
    place, tie = buffer_order(F.col(key), buffer, seed)
    made = rows.withColumn("__place", place).withColumn("__tie", tie)
    return made.repartitionByRange("__place", "__tie").sortWithinPartitions("__place", "__tie").drop("__place", "__tie")


def sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement (all, if fewer), the same for the same seed."""
    return rows.orderBy(_digest(F.col(key), seed), key).limit(k)


def zipped(left: DataFrame, right: DataFrame, key: str = "_idx") -> DataFrame:
    """Rows of two tables with the same number side by side; an error if one has a number that the other lacks."""
    there = [rows.select(key).withColumn(f"__{side}", F.lit(1)) for side, rows in (("left", left), ("right", right))]
    lone = there[0].join(there[1], key, "full").filter("__left IS NULL OR __right IS NULL")
    if not lone.isEmpty():
        raise ValueError("the tables don't have the same rows")
    return left.join(right, key)


def looked_up(rows: DataFrame, cache: DataFrame, key: str, otherwise: str, name: str) -> DataFrame:
    """``rows`` with the ``value`` that a cache has for their key, else with another of their columns."""
    return rows.join(cache.select(key, F.col("value").alias("__value")), key, "left").withColumn(name, F.coalesce("__value", otherwise)).drop("__value")


def pending(rows: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose keys are in none of the ``done`` tables; key -1 there means nothing."""
    if not done:
        return rows
    keys = done[0].select(key)
    for d in done[1:]:
        keys = keys.unionByName(d.select(key))
    return rows.join(keys.filter(F.col(key) >= 0).distinct(), key, "left_anti")


def pending_by_question(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose question has no record yet with a response and at least one tool call."""
    good = done.filter((F.trim("response") != "") & (F.col("num_tool_calls") >= 1)).select("question").distinct()
    return rows.join(good, "question", "left_anti")


def latest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the value that came last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def split(key: Column, share: float, seed: int = 0) -> Column:
    """Whether a row belongs to the validation part, by a hash of its key."""
    return _draw(key, seed) < F.lit(share)


def split_rows(rows: DataFrame, key: str, size: float | int, seed: int = 0) -> DataFrame:
    """``rows`` with ``held_out``: a share of them (a float), or so many (an int)."""
    if isinstance(size, float):
        return rows.withColumn("held_out", split(F.col(key), size, seed))
    chosen = sample(rows.select(key), key, size, seed).select(F.col(key).alias("__chosen"))
    return rows.join(chosen, rows[key] == chosen["__chosen"], "left").withColumn("held_out", F.col("__chosen").isNotNull()).drop("__chosen")


def concatenated(named: dict[str, DataFrame], max_samples: int | None = None, order: str | None = None) -> DataFrame:
    """All sources under each other with ``_dataset_name``; of each at most so many rows, first ones by ``order``."""
    parts = []
    for name, rows in named.items():
        rows = rows.orderBy(order).limit(max_samples) if max_samples is not None else rows
        parts.append(rows.withColumn("_dataset_name", F.lit(name)))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p, allowMissingColumns=True)
    return made


def interleaved(named: dict[str, DataFrame], key: str, counts: dict[str, int], over: bool = False) -> DataFrame:
    """Sources taken in turns: until the first is used up, or with ``over`` until all are.

    The place of a row is its number within its source (a dense ``key``) and the number of the
    source; with ``over`` shorter sources start again. Nothing is sorted: the
    result has ``turn`` and ``source_no`` to sort by.
    """
    names = list(named)
    turns = max(counts.values()) if over else min(counts.values())
    parts = []
    for no, name in enumerate(names):
        repeats = -(-turns // max(1, counts[name]))
        rows = named[name].withColumn("__again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        rows = rows.withColumn("turn", F.col("__again") * counts[name] + F.col(key)).filter(F.col("turn") < turns).drop("__again")
        parts.append(rows.withColumn("source_no", F.lit(no)).withColumn("_dataset_name", F.lit(name)))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p, allowMissingColumns=True)
    return made


def drawn(named: dict[str, DataFrame], key: str, counts: dict[str, int], shares: list[float], seed: int = 0) -> DataFrame:
    """Sources taken by chance, each with its share, until one that is used up is drawn.

    Each turn draws a source by a hash of its number; the n-th turn of a source takes its row n (a dense ``key``).
    """
    names, upto = list(named), [sum(shares[: i + 1]) for i in range(len(shares))]
    spark = next(iter(named.values())).sparkSession
    turns = spark.range(sum(counts.values()) + 1).select(F.col("id").alias("turn"), _draw(F.col("id"), seed).alias("u"))
    of = F.size(F.filter(F.array(*map(F.lit, upto[:-1])), lambda x: x <= F.col("u")))
    turns = numbered(turns.select("turn", of.alias("source_no")), "turn", key, by="source_no")
    limits = F.element_at(F.array(*(F.lit(counts[n]) for n in names)), F.col("source_no") + 1)
    end = turns.filter(F.col(key) >= limits).agg(F.min("turn")).first()[0]
    parts = [named[n].withColumn("source_no", F.lit(i)).withColumn("_dataset_name", F.lit(n)) for i, n in enumerate(names)]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p, allowMissingColumns=True)
    return made.join(turns.filter(F.col("turn") < F.lit(end)), ["source_no", key])


def listed(value: Column, kind: str) -> Column:
    """A column that holds a list, or one value in place of a list of one, as a list; null as an empty one."""
    return F.coalesce(value if kind.startswith("array") else F.when(value.isNotNull(), F.array(value)), F.array().cast(kind if kind.startswith("array") else f"array<{kind}>"))


def image_paths(rows: DataFrame, images: str = "images") -> DataFrame:
    """One row per image with whether its path is relative; scalars and lists were made lists at the scan."""
    return rows.select("*", F.explode(images).alias("path")).withColumn("relative", ~F.startswith("path", F.lit("/")))


def missing_images(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Distinct paths that a listing of files doesn't have."""
    return paths.select("path").distinct().join(listing.select("path"), "path", "left_anti")
