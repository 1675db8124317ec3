"""Packing of samples into blocks of a fixed length.

Which sample goes where follows from the lengths alone, and equal lengths are interchangeable. So best-fit-decreasing is run
on the histogram of lengths, which has at most ``cutoff`` bars however many rows there are: all samples of a length are placed
at once into all blocks with the same room. That gives the plan, some pieces for each length. The rows are numbered
within their length and look their number up in the plan; only keys and lengths are shuffled, and no task sees
more than a part of a length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a length that are numbered together, about.
PART_ROWS = 500_000
#: The most pieces of a plan that are broadcast.
MOST_PIECES = 5_000_000
#: A piece: so many samples of a length, from one number on, ``each`` of them to a block; the first block, its room taken and its samples so far.
PIECE = ("length", "first", "n", "each", "block", "offset", "before")


def plan(histogram: dict[int, int], cutoff: int) -> tuple[list[tuple[int, ...]], int]:
    """Pieces in the order of (length, first), and the number of blocks, by best-fit-decreasing.

    The next of the longest samples left goes to the block with the least room that has enough, else to a new one. Blocks with
    the same room are kept as ranges of numbers, and each range takes as many samples as it has room for.
    """
    pieces: list[tuple[int, ...]] = []
    ranges: dict[int, list[tuple[int, int, int]]] = {}  # by room: first block, blocks, samples in each
    rooms: list[int] = []
    blocks = 0

    def put(room: int, first: int, n: int, before: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n, before))

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        if not 0 < length <= cutoff:
            raise ValueError(f"a sample of {length} doesn't fit into a block of {cutoff}")
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else cutoff
            each = room // length
            if at < len(rooms):
                first, n, before = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                first, n, before = blocks, -(-left // each), 0
                blocks += n
            full = min(n, left // each)
            rest = min(left, each * n) - full * each  # what the next block gets
            if full or rest:
                pieces.append((length, number, full * each + rest, each, first, cutoff - room, before))
            put(room - each * length, first, full, before + each)
            put(room - rest * length, first + full, int(rest > 0), before + rest)
            put(room, first + full + (rest > 0), n - full - (rest > 0), before)
            number += full * each + rest
            left -= full * each + rest
    return sorted(pieces), blocks


def packed(rows: DataFrame, key: str, length: Column, cutoff: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``key, length, block, offset, no`` for each row: its block, where it begins there, and which sample of the block it is (from 1).

    Samples longer than ``cutoff`` are cut to it; null lengths and those under 1 take no part, and have no block. Within a length the
    rows are in the order of a hash of their keys, so equal tables are packed alike, however they are split. Rows with equal keys are
    kept, in any order.
    """
    spark = rows.sparkSession
    sized = rows.select(F.col(key), F.when(length > 0, F.least(length, F.lit(cutoff))).cast("long").alias("length"))
    histogram = {r["length"]: r["count"] for r in sized.filter("length IS NOT NULL").groupBy("length").count().collect()}
    pieces, _ = plan(histogram, cutoff)
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"a plan of {len(pieces)} pieces is too large; use a smaller cutoff")
    parts = max(1, -(-max(histogram.values(), default=0) // part_rows))
    dealt = sized.withColumn("__hash", F.xxhash64(key)).withColumn("__part", F.pmod("__hash", F.lit(parts)))
    own = Window.partitionBy("length", "__part")
    within = dealt.withColumn("__in", F.row_number().over(own.orderBy("__hash", key)) - 1)
    counts = dealt.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).drop("__n")
    starts = starts.select(F.col("length").alias("__l"), F.col("__part").alias("__p"), "__start")
    numbered = within.join(starts, F.col("length").eqNullSafe(F.col("__l")) & (F.col("__part") == F.col("__p"))).select(key, "length", (F.col("__in") + F.col("__start")).alias("__number"))
    table = np.array(pieces, np.int64).reshape(-1, len(PIECE))
    shared = spark.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {name: shared.value[:, i] for i, name in enumerate(PIECE)}
        # pieces are sorted by length and first number; one number for both finds the last piece that begins early enough
        widest = int(max(of["first"].max(initial=0), 1)) + 1
        starts = of["length"] * widest + of["first"]
        for batch in batches:
            lengths, numbers = batch.column("length"), batch.column("__number").to_numpy()
            there = lengths.is_valid().to_numpy(zero_copy_only=False)
            size = lengths.fill_null(0).to_numpy()
            at = np.searchsorted(starts, size * widest + np.minimum(numbers, widest - 1), side="right") - 1
            at = np.where(there, at, 0) if len(table) else np.zeros(len(size), np.int64)
            if len(table):
                along = numbers - of["first"][at]
                nth = along % of["each"][at]
                made = [of["block"][at] + along // of["each"][at], of["offset"][at] + nth * size, of["before"][at] + nth + 1]
            else:
                made = [np.zeros(len(size), np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, *(pa.array(m, pa.int64(), mask=~there) for m in made)], names=[key, "length", "block", "offset", "no"])

    schema = numbered.select(key, "length").schema.add("block", "long").add("offset", "long").add("no", "long")
    return numbered.mapInArrow(look_up, schema)


def masks(rows: DataFrame, cutoff: int, neat: bool = True) -> DataFrame:
    """``block, mask`` of packed rows: the number of the sample at each place (only 1 if not ``neat``), and 0 for padding.

    A block has at most ``cutoff`` samples, so what is gathered for one is bounded.
    """
    runs = rows.filter("block IS NOT NULL").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("no", "length"))).alias("runs"))
    filled = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["no"] if neat else F.lit(1).cast("long"), r["length"].cast("int"))))
    return runs.select("block", F.concat(filled, F.array_repeat(F.lit(0).cast("long"), F.lit(cutoff) - F.size(filled))).alias("mask"))


def joined(rows: DataFrame, packed_rows: DataFrame, key: str, ids: str, cutoff: int) -> DataFrame:
    """``block, ids``: the token ids of all samples of a block, one after the other. Padding is left to the mask."""
    cut = rows.select(F.col(key), F.slice(ids, F.lit(1), F.lit(cutoff)).alias("__ids"))
    both = packed_rows.filter("block IS NOT NULL").join(cut, key)
    listed = both.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("no", "__ids"))).alias("__all"))
    return listed.select("block", F.flatten(F.transform("__all", lambda r: r["__ids"])).alias("ids"))
