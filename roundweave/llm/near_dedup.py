"""Near-duplicates by MinHash with tensored banding (operator 4).

A document's set is that of its distinct 5-word shingles. Documents are linked if
the Jaccard similarity of their sets is at least 3/4.

MinHash banding needs a table for every band, and a band of r hashes for each.
Tensored banding takes two families of small collections of hashes, ``SIDE``
collections of two hashes in each, and forms a table key from every pair of
one collection of either family: ``SIDE`` squared tables with keys of four
hashes, from 4 * ``SIDE`` hashes and not 4 * ``SIDE`` squared. A pair of similarity s
fails to meet with a chance of at most 2 * (1 - s^2)^SIDE: 4 in a million at 3/4, and less
above. A key can only be shared where both its collections are, so collections that no other document
has are left out before keys are formed; a document without relatives has next to none.

Candidates are verified on the full sets. All members of a table's bucket are
never compared with each other:

1. Documents with equal sets are one class; the smallest id stands for it.
2. Every class is compared with one candidate: of the smallest members of its
   buckets, the one it shares most tables with. The links make components.
   A candidate that many are compared with is dealt out, with its set, to a task for about every ``BLOCK`` of them.
3. What could still be linked are members of a bucket in different components.
   Only buckets that have such members are looked at. The members outside of a bucket's largest
   component are compared with all, in blocks of ``BLOCK`` rows by ``BLOCK`` rows if they are many, so that
   the work follows the size of the bucket where few are outside. Signatures rule out the pairs that are too
   unlike (a pair at 3/4 is ruled out with a chance of 2 in a million); the
   components that what is left joins are neighbours. No pairs are
   given out, only as many as it takes to join the components of a bucket.
4. The members of neighbouring components are brought together with their sets, those outside of the
   largest against all, in blocks of about ``BLOCK_SHINGLES`` shingles by as many. An inverted index
   over a block's shingles counts what its members have in common, and links between
   components are given out, again no more than it takes to join them.

Shingles are told apart by 64-bit hashes of their words.

Edge cases: a text without words (or null, or empty) has an empty set and is linked with
nothing; a text with fewer than five words has its whole sequence as its only shingle; rows
that share an id are one document, and linked if any of its texts is; a row with a
null id is linked with nothing, has no component, and is kept; an empty table gives
an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.llm.common import CACHES, discard, mixed, only_caches_of, saved, small_batches, utf8
from roundweave.llm.components import components

WORDS = 5
#: Collections in each of the two families; hashes in each collection.
SIDE, ROWS = 16, 2
HASHES = 2 * SIDE * ROWS
#: Members of a bucket that one row of the last step holds from one block.
BLOCK = 512
#: Shingles that one row of the last step holds from one block, about.
BLOCK_SHINGLES = 1_000_000
#: Equal hashes out of HASHES that a pair must have to be verified in the last step.
LEAST_EQUAL = HASHES // 2
_RANDOM = np.random.default_rng(75)
XORS = _RANDOM.integers(0, 2**64, HASHES, np.uint64)
FACTORS = _RANDOM.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()
CACHES["near_dedup"] = _words.clear


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.split() splits at \\x20 and \\x09-\\x0D."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(one) - width + 1
    chain = np.full(n, np.uint64(width))
    for k in range(width):
        chain = mixed(chain * MIX + one[k : k + n])
    return np.unique(chain)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, a row for each."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if sets:
        every = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((every ^ XORS[k]) * FACTORS[k] >> np.uint64(32)).astype(np.uint32), starts)
    return out


def collections(signature: np.ndarray) -> np.ndarray:
    """Hashes of the collections of both families, told apart by their numbers."""
    s = signature.astype(np.uint64).reshape(len(signature), 2 * SIDE, ROWS)
    key = np.arange(2 * SIDE, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mixed(key * MIX + s[:, :, r])
    return np.broadcast_to(key, s.shape[:2]).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature, bands`` of rows with doc_id and text (bytes)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("near_dedup")
        for batch in batches:
            sets = [shingle_set(v.as_py()) for v in batch.column(1)]
            some = [i for i, s in enumerate(sets) if len(s)]
            made = signatures([sets[i] for i in some])
            sign = dict(zip(some, made))
            bands = dict(zip(some, collections(made)))
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            rows = range(len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array([sign[i].tobytes() if i in sign else None for i in rows], pa.binary()), pa.array([bands[i] if i in bands else None for i in rows], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, signature binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """``id, shingles`` of rows with doc_id and text (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("near_dedup")
        for batch in batches:
            sets = [shingle_set(v.as_py()).view(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough by their full sets.

    ``n`` says how many pairs there may be with the same b; its set is given out once for every ``BLOCK`` of them.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / BLOCK)).cast("int")).drop("n")
    of_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    of_b = pairs.select("b", "part").distinct().join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = of_a.join(of_b, ["b", "part"]).withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(100 * F.col("common") >= 75 * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b").distinct()


class Joined:
    """Sets that are joined one by one."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _neighbours(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that members of a row join whose signatures don't rule each other out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("near_dedup")
        for batch in batches:
            out = []
            for row in range(len(batch)):
                m = batch.column(0).slice(row, 1).flatten()
                labels, sizes = m.field(1).to_numpy(), m.field(2).to_numpy()
                signs = np.frombuffer(b"".join(m.field(3).to_pylist()), np.uint32).reshape(len(labels), HASHES)
                rest = np.flatnonzero(m.field(0).to_numpy(zero_copy_only=False))
                seen = Joined()
                for i in range(0, len(rest), 64):
                    r = rest[i : i + 64]
                    equal = (signs[r][:, None, :] == signs[None, :, :]).sum(axis=2)
                    small, large = np.minimum(sizes[r][:, None], sizes), np.maximum(sizes[r][:, None], sizes)
                    x, y = np.nonzero((labels[r][:, None] != labels) & (equal >= LEAST_EQUAL) & (100 * small >= 75 * large))
                    pairs = np.unique(np.stack([labels[r[x]], labels[y]]), axis=1).T.tolist()
                    out += [(a, b) for a, b in pairs if seen.join(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _links(groups: DataFrame) -> DataFrame:
    """Links (a, b) between members of a row in different components, enough to join what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("near_dedup")
        for batch in batches:
            out = []
            for row in range(len(batch)):
                m = batch.column(0).slice(row, 1).flatten()
                outside, ids, labels, lists = m.field(0).to_numpy(zero_copy_only=False), m.field(1).to_numpy(), m.field(2).to_numpy(), m.field(3)
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                _, shingle = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                owner = np.repeat(np.arange(len(ids)), sizes)
                order = np.argsort(shingle, kind="stable")
                postings, begins = owner[order], np.r_[0, np.cumsum(np.bincount(shingle))]
                starts = np.cumsum(sizes) - sizes
                seen = Joined()
                for y in np.flatnonzero(outside).tolist():
                    mine = shingle[starts[y] : starts[y] + sizes[y]]
                    n = begins[mine + 1] - begins[mine]
                    at = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    common = np.bincount(postings[at], minlength=len(ids))
                    linked = np.flatnonzero((100 * common >= 75 * (sizes + sizes[y] - common)) & (labels != labels[y]))
                    _, one = np.unique(labels[linked], return_index=True)
                    out += [(int(ids[y]), int(ids[x])) for x in linked[one] if seen.join(int(labels[y]), int(labels[x]))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def _divided(members: DataFrame, group: str, size: Column, block: int) -> DataFrame:
    """Groups with several labels: ``major``, the label that has most of it, and in how many blocks
    (``outer``) what has other labels and (``blocks``) all are to be compared."""
    by_label = members.groupBy(group, "label").agg(F.sum(size).alias("size"))
    of = by_label.groupBy(group).agg(F.count(F.lit(1)).alias("labels"), F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("top")).filter("labels > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    return of.select(group, F.col("top.label").alias("major"), blocks(F.col("all") - F.col("top.size")).alias("outer"), blocks(F.col("all")).alias("blocks"))


def _in_blocks(members: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows that hold a block of the members outside of a group's major label, and one of all members.

    ``members`` has ``id, label`` and the columns of ``_divided``. The first column of a member says whether it is
    one of those outside. If these are one block, the others need not hold them too.
    """
    is_out = F.col("label") != F.col("major")
    many = F.col("outer") > 1
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = members.filter(is_out).withColumn("__out", F.lit(True)).withColumn("__o", own("outer")).withColumn("__b", every("blocks"))
    rest = members.filter(~is_out | many).withColumn("__out", F.lit(False)).withColumn("__b", own("blocks")).withColumn("__o", every("outer"))
    return out.unionByName(rest).groupBy(group, "__o", "__b").agg(F.collect_list(F.struct("__out", *columns)).alias("members")).select("members")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    raw = docs.select("doc_id", utf8(text).alias("text"))
    sketches = saved(_sketches(raw), "sketches")
    known = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0").withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = saved(
        known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "classes",
    )
    # an id with several texts links their classes
    owned = known.select("doc_id", "set_key").join(classes.select("set_key", "id"), "set_key")
    several = owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b")
    by_id = several.select(F.col("doc_id").alias("a"), F.col("a").alias("b")).unionByName(several.select(F.col("doc_id").alias("a"), F.col("b")))

    bands = classes.select("id", F.posexplode("bands").alias("no", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    bands = bands.join(shared, "band", "left_semi").groupBy("id").agg(
        F.collect_set(F.when(F.col("no") < SIDE, F.col("band"))).alias("one"),
        F.collect_set(F.when(F.col("no") >= SIDE, F.col("band"))).alias("two"),
    )
    tables = bands.select("id", F.explode("one").alias("one"), "two").select("id", "one", F.explode("two").alias("two")).select("id", F.xxhash64("one", "two").alias("key"))
    heads = tables.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("head <> last")
    tables = saved(tables.join(heads, "key").select("key", "id", "head", "n"), "tables")

    votes = tables.filter("id <> head").groupBy(F.col("id").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("n"))
    first = votes.groupBy("a").agg(F.max(F.struct("count", (-F.col("b")).alias("b"), "n")).alias("best")).select("a", (-F.col("best.b")).alias("b"), F.col("best.n").alias("n"))
    needed = tables.select(F.col("id").alias("doc_id")).distinct()
    sets = saved(_sets(raw.join(needed, "doc_id", "left_semi").select(F.col("doc_id").cast("long"), "text")), "sets")
    first = saved(first, "first")
    links = saved(verified(first, sets).unionByName(by_id), "links")
    labels = components(links)

    labelled = tables.join(labels, tables["id"] == labels["node"], "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    members = labelled.join(_divided(labelled, "key", F.lit(1), BLOCK), "key").join(classes.select("id", "n", "signature"), "id")
    near = components(_neighbours(_in_blocks(members, "key", "label", "n", "signature")))
    known_labels = labelled.select("id", "label").distinct()
    held = known_labels.join(near.select(F.col("node").alias("label"), F.col("component").alias("group")), "label")
    held = held.unionByName(known_labels.join(near.select(F.col("component").alias("label")).distinct(), "label").withColumn("group", F.col("label")))
    sized = held.join(classes.select("id", "n"), "id")
    more = _links(_in_blocks(sized.join(_divided(sized, "group", F.col("n"), BLOCK_SHINGLES), "group").join(sets, "id"), "group", "id", "label", "shingles"))
    final = components(links.unionByName(more))
    for done in (tables, first, sets, links, labels, near):
        discard(done)

    of_class = classes.select("set_key", "id").join(final, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one document of each component."""
    gone = near_duplicates(docs, text).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
