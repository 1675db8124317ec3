"""Removal of long repeated strings by a family of suffix arrays (operator 9).

Every byte that is covered by a string of ``length`` bytes which starts at
another place too is removed, whether that place is in the same document or not.

The arrays are sparse: of all suffixes they hold those that start at anchors. A
window (a string of ``length`` bytes) has its anchor where the hash of the next
``GRAM`` bytes is lowest, the leftmost such place; equal windows have equal
anchors, so two long matches always meet at suffixes of the arrays. There is an
anchor for about every (length - GRAM) / 2 bytes, which keeps the index at a
fraction of the text. An entry has the first ``GRAM`` bytes of its suffix, by
which the array is sorted, its places, and a fingerprint of all windows that it
is the anchor of.

Documents come in batches. A batch gets its array, which is merge-scanned
against itself and against the arrays of all levels: a sort-merge join on the
suffixes' beginnings. Then it becomes a level; before the next batch comes, two levels
of one size are merged into one of twice the size, so that there are logarithmically
many, and an entry is rewritten logarithmically often.

What the scans have matched is decided exactly (up to 128 bits of fingerprints).
Entries with the same fingerprint repeat in all their windows. Only where
entries begin alike but differ in their windows, which is at the ends of repeated
passages, are the windows themselves hashed and counted. Up to ``GROUP`` such
entries are brought together with the text around their anchors. A beginning with more
entries sends the hashes of their windows instead, dealt out by hash to as many
tasks as it has times ``GROUP`` entries, so that no task holds all places of a
passage. Other lists are collected per document, and are no longer than its text.

Edge cases: a null text is an empty one; texts under ``length`` bytes lose
nothing; of repeated rows each is a place of its own, so that both lose what
they share; rows with the same id and other texts, or with a null id, are kept
apart; what is left may begin or end within a character, so it is returned as
bytes; an empty table gives an empty table; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.llm.common import discard, mixed, saved, small_batches, utf8

LENGTH = 400
#: Bytes by which suffixes are compared first.
GRAM = 32
BATCHES = 4
#: Entries with one beginning that are compared in one task.
GROUP = 1000
#: Tasks that the entries with one beginning are dealt out to when beginnings are looked up.
SALTS = 8
#: Bytes whose anchors are looked for together; a place within has 24 bits.
CHUNK = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: One random number for each byte.
BYTES = np.random.default_rng(400).integers(0, 2**64, 256, np.uint64)


class Hashes:
    """Hashes of all substrings of a buffer, from running sums modulo 2^64."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes.powers) < n:
            Hashes.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
            Hashes.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE)])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTES[data] * self.powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverses[: len(self.sums)][start]


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows in a buffer of documents that end at ``ends``.

    Returns the buffer's hashes, and for each anchor its place and the first and last window of it.
    """
    hashes = Hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return hashes, none, none, none
    grams = mixed(hashes.of(slice(0, len(data) - GRAM + 1), slice(GRAM, None)))
    low24 = np.uint64(0xFFFFFF)
    keyed = (grams & ~low24) | np.arange(len(grams), dtype=np.uint64)
    best = (lowest(keyed, length - GRAM + 1) & low24).astype(np.int64)
    windows = np.arange(len(best))
    inside = np.zeros(len(data) + 1, bool)  # windows that end in the document they begin in
    begins = np.r_[0, ends[:-1]]
    marks = np.zeros(len(data) + 2, np.int64)
    long_enough = ends - begins >= length
    np.add.at(marks, begins[long_enough], 1)
    np.add.at(marks, ends[long_enough] - length + 1, -1)
    inside = np.cumsum(marks)[: len(best)] > 0
    windows, best = windows[inside], best[inside]
    if not len(windows):
        return hashes, none, none, none
    new = np.r_[True, (best[1:] != best[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(windows) - 1]
    return hashes, best[first], windows[first], windows[last]


ENTRY = "key binary, ctx long, doc_id {id}, text_hash long, before int, span int, places array<long>"


def _entries(docs: DataFrame, length: int) -> DataFrame:
    """The sparse suffix array of some documents, not sorted yet.

    ``places`` are the anchors with this fingerprint in this document; their
    windows begin ``before`` bytes ahead of them and the next ``span`` bytes.
    """
    small_batches(docs.sparkSession)

    def entries(batch: pa.RecordBatch, rows: np.ndarray, offsets: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        hashes, at, first, last = anchors(data, ends, length)
        ctx = hashes.of(first, last + length) + mixed(((at - first) * 1000 + (last - first)).astype(np.uint64) + np.uint64(1))
        piece = np.searchsorted(ends, at, side="right")
        doc = rows[piece]
        order = np.lexsort((ctx, doc))
        new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])] if len(order) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        one = order[starts]
        keys = [data[a : a + GRAM].tobytes() for a in at[one]]
        places = (at - np.r_[0, ends[:-1]][piece] + offsets[piece])[order]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), pa.array(places, pa.int64()))
        taken = pa.array(doc[one])
        made = [pa.array(keys, pa.binary()), pa.array(ctx[one].view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array((at - first)[one].astype(np.int32)), pa.array((last - first)[one].astype(np.int32)), lists]
        return pa.RecordBatch.from_arrays(made, names=["key", "ctx", "doc_id", "text_hash", "before", "span", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets, texts, held = [], [], [], 0
            for row, value in enumerate(batch.column(2)):
                text = value.as_py()
                # a longer text comes in parts that share all but one byte of a window
                for offset in range(0, max(1, len(text) - length + 1), CHUNK - length + 1):
                    part = text[offset : offset + CHUNK]
                    if len(part) < length:
                        continue
                    if held + len(part) > CHUNK and held:
                        yield entries(batch, np.array(rows), np.array(offsets), texts)
                        rows, offsets, texts, held = [], [], [], 0
                    rows.append(row)
                    offsets.append(offset)
                    texts.append(part)
                    held += len(part)
            if texts:
                yield entries(batch, np.array(rows), np.array(offsets), texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, ENTRY.format(id=kind))


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartition("key").sortWithinPartitions("key")


class SuffixIndex:
    """Sparse suffix arrays in levels of geometric sizes."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []
        self.matched: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Take in a batch (doc_id, text_hash, text as bytes), and note what it shares with all before."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((size + 1, saved(_sorted(one.unionByName(two)), "suffixes")))
            discard(one)
            discard(two)
        new = saved(_sorted(_entries(docs, self.length)), "suffixes")
        keys = new.groupBy("key").agg(F.sum(F.size("places")).alias("n"))
        found = keys.filter("n > 1").select("key")
        for _, level in self.levels:
            found = found.unionByName(keys.join(level.select("key").distinct(), "key", "left_semi").select("key"))
        self.matched.append(saved(found.distinct(), "matched"))
        self.levels.append((0, new))

    def entries(self) -> DataFrame:
        """The entries whose beginnings the scans have found more than once."""
        every, keys = self.levels[0][1], self.matched[0]
        for _, level in self.levels[1:]:
            every = every.unionByName(level)
        for more in self.matched[1:]:
            keys = keys.unionByName(more)
        return _dealt_join(every, keys.distinct(), F.xxhash64("doc_id", "text_hash"), "left_semi")


def _dealt_join(rows: DataFrame, keys: DataFrame, by: Column, how: str) -> DataFrame:
    """A join on beginnings, which are distinct in ``keys``, with the rows of each dealt out by a hash."""
    rows = rows.withColumn("__salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    return rows.join(keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "__salt"], how).drop("__salt")


def _window_hashes(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of the windows asked for, dealt out by hash: ``key, shard, doc_id, text_hash,
    single, starts, hashes``. ``docs`` has doc_id, text_hash, text and ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                text = np.frombuffer(batch.column(2)[row].as_py(), np.uint8)
                asked = batch.column(3).slice(row, 1).flatten()
                keys, shards, singles, starts, hashes = [], [], [], [], []
                for at, before, span, single, key, n in zip(*(asked.field(i).to_pylist() for i in range(6))):
                    first = at - before
                    whole = Hashes(text[first : first + span + length])
                    w = mixed(whole.of(slice(0, span + 1), slice(length, None)))
                    shard = (w >> np.uint64(33)) % np.uint64(n)
                    for k in np.unique(shard):
                        mine = np.flatnonzero(shard == k)
                        keys.append(key)
                        shards.append(int(k))
                        singles.append(single)
                        starts.append(first + mine)
                        hashes.append(w[mine].view(np.int64))
                taken = pa.array(np.full(len(keys), row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(shards, pa.int32()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(singles), pa.array(starts, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["key", "shard", "doc_id", "text_hash", "single", "starts", "hashes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text", "asked").mapInArrow(run, f"key binary, shard int, doc_id {kind}, text_hash long, single boolean, starts array<long>, hashes array<long>")


RUNS = "array<struct<first:long,last:long>>"


def _counted(groups: DataFrame, kind: str) -> DataFrame:
    """Repeated windows, from rows that hold all windows of one beginning and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                group = batch.column(0).slice(row, 1).flatten()
                starts, hashes = group.field(3), group.field(4)
                entry = np.repeat(np.arange(len(group)), starts.value_lengths().to_numpy())
                _, which, counts = np.unique(hashes.flatten().to_numpy(), return_inverse=True, return_counts=True)
                again = (counts[which] > 1) & group.field(2).to_numpy(zero_copy_only=False)[entry]
                at = starts.flatten().to_numpy()[again]
                yield _runs(group.field(0), group.field(1), entry[again], at, at)

    return groups.mapInArrow(run, f"doc_id {kind}, text_hash long, runs {RUNS}")


def _runs(ids: pa.Array, text_hashes: pa.Array, entry: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """A row for each entry that has runs; ``entry`` ascends."""
    own = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if len(entry) else np.zeros(0, np.int64)
    taken = pa.array(entry[own])
    runs = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["first", "last"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[own, len(entry)].astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays([ids.take(taken), text_hashes.take(taken), lists], names=["doc_id", "text_hash", "runs"])


AROUND = "key binary, doc_id {id}, text_hash long, first long, single boolean, around binary"


def _around(docs: DataFrame, length: int) -> DataFrame:
    """The text of all windows of the entries asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column(2)[row].as_py()
                asked = batch.column(3).slice(row, 1).flatten()
                first = asked.field(0).to_numpy() - asked.field(1).to_numpy()
                around = [text[f : f + s + length] for f, s in zip(first.tolist(), asked.field(2).to_pylist())]
                taken = pa.array(np.full(len(first), row))
                yield pa.RecordBatch.from_arrays([asked.field(4), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(first), asked.field(3), pa.array(around, pa.binary())], names=["key", "doc_id", "text_hash", "first", "single", "around"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text", "asked").mapInArrow(run, AROUND.format(id=kind))


def _compared(groups: DataFrame, kind: str, length: int) -> DataFrame:
    """Runs of repeated windows, from rows that hold all entries of a beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                group = batch.column(0).slice(row, 1).flatten()
                texts = group.field(4).to_pylist()
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                n = sizes - length + 1
                begins = np.cumsum(sizes) - sizes
                entry = np.repeat(np.arange(len(texts)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = begins[entry] + step
                whole = Hashes(np.frombuffer(b"".join(texts), np.uint8)).of(at, at + length)
                _, which, counts = np.unique(whole, return_inverse=True, return_counts=True)
                again = (counts[which] > 1) & group.field(3).to_numpy(zero_copy_only=False)[entry]
                entry, step = entry[again], step[again]
                if not len(entry):
                    continue
                new = np.r_[True, (entry[1:] != entry[:-1]) | (step[1:] != step[:-1] + 1)]
                start = np.flatnonzero(new)
                end = np.r_[start[1:] - 1, len(entry) - 1]
                first = group.field(2).to_numpy()[entry[start]]
                yield _runs(group.field(0), group.field(1), entry[start], first + step[start], first + step[end])

    return groups.mapInArrow(run, f"doc_id {kind}, text_hash long, runs {RUNS}")


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _asked(docs: DataFrame, alike: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of the entries with the given beginnings, with a list of these in each."""
    asked = _dealt_join(alike, keys.select("key", F.ceil(F.col("kinds") / GROUP).alias("shards")), F.col("ctx"), "inner")
    asked = asked.select("one.doc_id", "one.text_hash", F.struct("one.at", "one.before", "one.span", (F.col("n") == 1).alias("single"), "key", "shards").alias("ask"))
    asked = asked.groupBy("doc_id", "text_hash").agg(F.collect_list("ask").alias("asked"))
    # of equal rows, which are not single, one will do
    return docs.join(asked, _same_doc(docs, asked)).select(docs["doc_id"], docs["text_hash"], "text", "asked")


def repeated(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """``doc_id, text_hash`` and ``starts``: runs (first, last) of windows that repeat.

    ``docs`` has doc_id, text_hash and text as bytes. Equal rows get one row.
    """
    index = SuffixIndex(length)
    for b in range(batches):
        index.add(docs.filter(F.pmod("text_hash", F.lit(batches)) == b))
    entries = saved(index.entries(), "matched")
    alike = entries.groupBy("key", "ctx").agg(
        F.sum(F.size("places")).alias("n"),
        F.min(F.struct("doc_id", "text_hash", F.col("places")[0].alias("at"), "before", "span")).alias("one"),
    )
    alike = saved(alike, "alike")
    kinds = saved(alike.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("key", "kinds"), "kinds")
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = _around(_asked(docs, alike, kinds.filter(F.col("kinds") <= GROUP)), length).groupBy("key")
    some = _compared(few.agg(F.collect_list(F.struct("doc_id", "text_hash", "first", "single", "around")).alias("group")).select("group"), kind, length)
    many = kinds.filter(F.col("kinds") > GROUP)
    if not many.isEmpty():
        windows = _window_hashes(_asked(docs, alike, many), length).groupBy("key", "shard")
        some = some.unionByName(_counted(windows.agg(F.collect_list(F.struct("doc_id", "text_hash", "single", "starts", "hashes")).alias("group")).select("group"), kind))
    whole = entries.join(alike.filter("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi")
    begin = lambda at: at - F.col("before")
    whole = whole.select("doc_id", "text_hash", F.transform("places", lambda at: F.struct(begin(at).alias("first"), (begin(at) + F.col("span")).alias("last"))).alias("runs"))
    runs = some.unionByName(whole)
    return runs.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("starts"))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as doc_id, text_hash and text in bytes."""
    return docs.select("doc_id", utf8(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = BATCHES, digests: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and what is left of every text.

    What is left is ``kept`` (bytes), or with ``digests`` its SHA-256.
    """
    rows = keyed(docs, text)
    runs = repeated(rows, length, batches)
    both = rows.join(runs, _same_doc(rows, runs), "left").select(rows["doc_id"], rows["text"], "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "kept_sha256 string" if digests else "kept binary"

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            out = []
            for row in range(len(batch)):
                data = batch.column(1)[row].as_py()
                starts = batch.column(2).slice(row, 1).flatten()
                if len(starts):
                    marks = np.zeros(len(data) + 1, np.int64)
                    np.add.at(marks, starts.field(0).to_numpy(), 1)
                    np.add.at(marks, starts.field(1).to_numpy() + length, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, spans = data, 0
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digests else kept))
            kinds = [pa.int64()] * 3 + [pa.string() if digests else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last}")
