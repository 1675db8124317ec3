"""Mixing sources to target weights (operator 10).

Weighted fair queueing over documents. Within each source the documents are
shuffled by a hash of their keys; each copy of a document has the virtual finish
time (tokens of its source up to and with it) / (target of its source). Taking
copies in the order of these times serves all sources in proportion to their
targets at every moment. The order is found by a global range sort, and cut
where the total budget is used up.

Running totals never run over a source in one task: a source is split by hash
into buckets of some 2,000 rows, their sums are added up first in groups of as many buckets, and running
sums are taken over groups, over the buckets of a group, and within buckets. The cut is found the same way, from the sums of
the sorted ranges; only the range in which the budget ends is run through. Rows of a source that share a key
(as those without one do) would share a bucket: where there are more than a bucket's rows of them, each gets one of as many
places in the order as that makes buckets, by its content and its number among equal rows, so that reruns agree however the table is split.

Targets: the budget is shared by weight; a target stops at ``max_repeats`` times
the size of its source, and what is over goes to the others by weight until no
target is above. That is one level for all sources that are not full, found
from running sums over one row per source.

Edge cases: a null or blank text has size 0, and takes nothing; a null source is
a source of its own, ordered last; null keys and repeated rows are rows like
others (the hash of a null key is that of an empty one); with nothing to take all targets are 0; an empty
table gives an empty table. Columns with clashing names: internal columns start
with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundweave.llm.common import saved

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
BUCKET_ROWS = 2000
#: The most rows of a table that is broadcast here (one row per source or range).
BROADCAST_ROWS = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(key: Column, seed: int) -> Column:
    """52 bits that put the rows of a source into a random but fixed order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, max_repeats: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source with its number, size, rows and target, from (source, size) rows.

    The windows here run over one row per source, already summed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    all_sources = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__no") - 1) % len(weights) + 1).cast("int")).cast("double")
    filled = Window.orderBy("__fill", "__no")
    level = F.when(F.col("__w_open") > 0, (F.col("__budget") - F.col("__full")) / F.col("__w_open"))
    return (
        by_source.withColumn("__no", F.row_number().over(all_sources))
        .withColumn("__weight", weight)
        .withColumn("__cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("__fill", F.col("__cap") / F.col("__weight"))
        # if the sources before this one are full, all others reach this level
        .withColumn("__full", F.coalesce(F.sum("__cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__w_open", F.sum("__weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("__level", level)
        # these levels fall from the first source on that is above its own, and that one's holds
        .withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__fill"), F.col("__level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("__level") < F.col("__fill"), F.col("__level") * F.col("__weight")).otherwise(F.col("__cap")))
        .select(F.col("source").alias("__of"), F.col("__no").alias("__src"), "source_size", "__rows", "target", F.floor("__budget").alias("__budget"))
    )


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with the columns of their sources. Broadcast while there are few
    sources; beyond that the sources are repeated for each of some salts, so that
    a hot source is spread over as many tasks."""
    if targets.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(targets), rows["source"].eqNullSafe(targets["__of"])).drop("__of")
    salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt2", F.pmod(F.col("__key"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["source"].eqNullSafe(salted["__of"]) & (rows["__salt2"] == salted["__salt"])).drop("__of", "__salt", "__salt2")


def _spread(rows: DataFrame, seed: int) -> DataFrame:
    """New keys for rows whose key more than a bucket's rows of their source share.

    Rows that are equal in id, size and content are numbered, by counts for each of them and each partition of the table and within these, and dealt out
    by that number. Which of equal rows has which number depends on how the table is split; how many of them get which key does not.
    """
    hot = rows.groupBy("source", "__key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("__parts")).filter("__parts > 1")
    hot = saved(hot.select(F.col("source").alias("__hot_source"), F.col("__key").alias("__hot"), "__parts"), "hot")
    found = hot.count()
    if not found:
        return rows
    hot = F.broadcast(hot) if found <= BROADCAST_ROWS else hot
    placed = rows.withColumn("__split", F.spark_partition_id()).withColumn("__line", F.monotonically_increasing_id())
    both = placed.join(hot, placed["source"].eqNullSafe(hot["__hot_source"]) & (placed["__key"] == hot["__hot"]), "left")
    equal = ["source", "doc_id", "size", "__content"]
    warm = both.filter("__parts IS NOT NULL").withColumn("__in", F.row_number().over(Window.partitionBy(*equal, "__split").orderBy("__line")))
    counts = both.filter("__parts IS NOT NULL").groupBy(*equal, "__split").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.partitionBy(*equal).orderBy("__split")) - F.col("__n")).drop("__n")
    starts = starts.select(*(F.col(c).alias(f"__of_{c}") for c in (*equal, "__split")), "__start")
    numbered = warm.join(starts, F.expr(" AND ".join(f"{c} <=> __of_{c}" for c in (*equal, "__split"))))
    part = F.pmod(F.xxhash64("__content", "size") + F.col("__start") + F.col("__in"), F.col("__parts"))
    key = shuffle_key(F.concat_ws(":", F.lit("part"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), part.cast("string")), seed)
    return both.filter("__parts IS NULL").select(*rows.columns).unionByName(numbered.withColumn("__key", key).select(*rows.columns))


def queue(rows: DataFrame, share: float, max_repeats: int, seed: int) -> DataFrame:
    """Each row's place in the queue of its source: ``__end`` is the running size.

    ``rows`` has ``doc_id, source, size`` and may have more columns; ``__content``, a hash of the text, tells rows with one id apart.
    """
    rows = rows if "__content" in rows.columns else rows.withColumn("__content", F.lit(0).cast("long"))
    rows = _spread(rows.withColumn("__key", shuffle_key(F.col("doc_id"), seed)), seed)
    targets = saved(source_targets(rows, share, max_repeats), "targets")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("__rows") / BUCKET_ROWS))
    placed = _with_targets(rows, targets).withColumn("__bucket", F.floor(F.col("__key") / F.lit(2.0**52) * buckets))
    sums = placed.groupBy("__src", "__bucket").agg(F.sum("size").alias("__sum")).withColumn("__group", F.floor(F.col("__bucket") / BUCKET_ROWS))

    def before(order: str, *by: str) -> Column:
        return F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = sums.groupBy("__src", "__group").agg(F.sum("__sum").alias("__sum")).select("__src", "__group", before("__group", "__src").alias("__first"))
    starts = sums.withColumn("__then", before("__bucket", "__src", "__group")).join(groups, ["__src", "__group"])
    starts = starts.select(F.col("__src").alias("__s"), F.col("__bucket").alias("__b"), (F.col("__first") + F.col("__then")).alias("__start"))
    within = Window.partitionBy("__src", "__bucket").orderBy("__key", "doc_id", "size", "__content").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.withColumn("__in", F.sum("size").over(within))
    return ended.join(starts, (ended["__src"] == starts["__s"]) & (ended["__bucket"] == starts["__b"])).withColumn("__end", F.col("__start") + F.col("__in")).drop("__s", "__b", "__start", "__in", "__bucket", "__rows")


def _copy(i: Column) -> Column:
    """What the i-th copy of a row is sorted by; the virtual finish time first."""
    time = (F.col("source_size") * i + F.col("__end")) / F.col("target")
    return F.struct(time.alias("time"), F.col("__src").alias("src"), i.cast("long").alias("copy"), F.col("__end").alias("end"))


def cut(queued: DataFrame, max_repeats: int) -> tuple | None:
    """What the last copy that the budget has room for is sorted by.

    The copies are range-sorted over the cluster. The sums of the ranges say in
    which range the budget ends; within it a running sum says where.
    """
    copies = queued.filter("size > 0 AND target > 0").select("size", "__budget", F.explode(F.array(*(_copy(F.lit(i)) for i in range(max_repeats)))).alias("__at"))
    ranges = saved(copies.repartitionByRange("__at").sortWithinPartitions("__at").withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("__range").agg(F.sum("size").alias("__sum"), F.max("__budget").alias("__budget"), F.max("__at").alias("__last"))
    sums = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    whole = sums.filter("__start + __sum <= __budget").agg(F.max("__last")).first()[0]
    ends = sums.filter("__start <= __budget AND __start + __sum > __budget").select("__range", "__start").first()
    if ends is None:
        return whole
    running = F.sum("size").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    part = ranges.filter(F.col("__range") == ends["__range"]).withColumn("__run", running + ends["__start"])
    return part.filter("__run <= __budget").agg(F.max("__at")).first()[0] or whole


def decided(queued: DataFrame, last: tuple | None, max_repeats: int) -> DataFrame:
    """``queued`` with ``copies``, ``taken`` and the places of the taken copies."""
    if last is None:
        places = F.filter(F.array(_copy(F.lit(0))), lambda _: F.lit(False))
    else:
        end = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["src"]).alias("src"), F.lit(last["copy"]).cast("long").alias("copy"), F.lit(last["end"]).cast("long").alias("end"))
        takes = (F.col("size") > 0) & (F.col("target") > 0)
        places = F.filter(F.array(*(_copy(F.lit(i)) for i in range(max_repeats))), lambda at: takes & (at <= end))
    out = queued.withColumn("__copies", places).withColumn("copies", F.size("__copies").cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_counts(sized: DataFrame, share: float = 1.5, max_repeats: int = 2, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per row.

    ``copies`` is how often the mix takes the row, ``taken`` the words that makes.
    ``sized`` has ``doc_id, source, size``.
    """
    queued = saved(queue(sized.select("doc_id", "source", "size"), share, max_repeats, seed), "queued")
    return decided(queued, cut(queued, max_repeats), max_repeats).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, seed: int = 7, text: str = "text") -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as taken, in mixed order.

    The order and the cut are found on the sizes alone. Whole rows are moved
    twice: to their places in the queues, and to their places in the mix, which
    is range-partitioned and sorted by virtual finish time.
    """
    sized = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__content"), F.struct(*docs.columns).alias("__row"))
    queued = saved(queue(sized.select("doc_id", "source", "size", "__content"), share, max_repeats, seed), "queued")
    last = cut(queued, max_repeats)
    taken = decided(queue(sized, share, max_repeats, seed), last, max_repeats).select("__row", F.explode("__copies").alias("__at"))
    return taken.repartitionByRange("__at").sortWithinPartitions("__at").select("__row.*")
