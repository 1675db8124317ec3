"""Toxicity scores (operator 2).

Logistic regression over hashed word n-grams and skip-grams, fitted by
FTRL-proximal: each coordinate has its own learning rate, and L1 keeps a weight
at zero until the evidence for it is strong, so that the weights which remain
are few. They are broadcast to the tasks that score; their number is bounded by
the number of hash buckets.

A document's features are the set of buckets of its words, of its pairs of
neighbours and of pairs with one or two words between. Words are runs of
letters, digits and underscores after lower-casing.

Fitting takes a bounded sample of the labelled rows that have a document: those with the smallest
hashes of their keys, at most ``max_rows`` of them, of at most ``max_bytes`` of text and ``max_features``
features together (all are parameters); a text of more than a sixteenth of these bytes isn't learned from. FTRL is sequential, so one task fits
the sample; scoring is one pass over all rows without a shuffle.

Edge cases: a null text counts as empty; an empty text has no features and gets
the score of the intercept; rows with a null key or label are not learned from;
a label without a document counts for nothing; a key with several labels counts as toxic if any of them says so; with no row
to learn from every score is 0.5; columns other than the key and the text are
not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundweave.llm.common import CACHES, only_caches_of, small_batches, utf8

#: log2 of the number of hash buckets.
BITS = 20
MAX_ROWS = 16_000
MAX_FEATURES = 24_000_000
MAX_BYTES = 128 << 20
WORD = re.compile(r"\w+")
#: Odd multipliers of the pair hashes, one for each distance. Any would do.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """Hashes of the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace")) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF
        return h


_words = WordHashes()
CACHES["toxicity"] = _words.clear


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of a text's n-grams and skip-grams, with repeats."""
    words = WORD.findall(text.lower())
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    parts = [one >> shift]
    for gap, mix in enumerate(MIX, 1):
        if len(one) > gap:
            parts.append(((one[:-gap] ^ mix) * mix + one[gap:] * MIX[0]) * mix >> shift)
    return np.concatenate(parts).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss over sets of buckets."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.intercept = size

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step for one row; ``at`` holds its distinct buckets."""
        at = np.append(at, self.intercept)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _order(key: str) -> Column:
    """What decides which labelled rows are in the sample."""
    return F.xxhash64(F.col(key).cast("string"))


def fit_ftrl(labelled: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, epochs: int = 6, **rates: float) -> tuple[np.ndarray, np.ndarray]:
    """Nonzero weights (bucket numbers, weights) learned from (key, text, label) rows.

    The columns must be named ``key``, ``text`` and ``label``, none of them null but
    the text. The last bucket is the intercept. At most ``2 ** bits + 1`` pairs come back to the driver.
    """
    small_batches(labelled.sparkSession)
    sample = labelled.select(_order("key").alias("o"), "key", utf8("text").alias("text"), F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_caches_of("toxicity")
        model, rows, held = Ftrl(2**bits, **rates), [], 0  # in the order of the hashes
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                at = np.unique(features(bytes(text).decode("utf-8", "replace"), bits)).astype(np.int32)
                if len(rows) < max_rows and held + len(at) <= max_features:
                    rows.append((at, label))
                    held += len(at)
        for _ in range(epochs):
            for at, label in rows:
                model.learn(at, label)
        w = model.weights(slice(None))
        (at,) = np.nonzero(w)
        yield pd.DataFrame({"bucket": at, "weight": w[at]})

    got = sample.repartition(1).sortWithinPartitions("o", "key").mapInPandas(run, "bucket long, weight double").toPandas()
    return got["bucket"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def score_ftrl(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text: str = "text", keys: Iterable[str] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """The key columns and ``score``, from 0 to 1, for every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    keys = list(keys)
    out = docs.select(*keys).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value, bits)
        for batch in batches:
            scores = [score(value.as_py()) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=out.names)

    return docs.select(*keys, utf8(text).alias("__text")).mapInArrow(run, out)


def _scorer(weights: tuple[np.ndarray, np.ndarray], bits: int) -> Callable[[bytes], float]:
    """The score of a text in bytes, by the weights."""
    only_caches_of("toxicity")
    at, w = weights
    dense = np.zeros(2**bits + 1)
    dense[at] = w
    told = dense != 0

    def score(text: bytes) -> float:
        x = features(text.decode("utf-8", "replace"), bits)
        total = dense[np.unique(x[told[x]])].sum() + dense[-1]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return score


def learned_from(key: Column) -> Column:
    """The rows whose labels may be learned: two thirds, by the CRC of the key."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``key, text, label``: the bounded sample of documents whose labels may be learned.

    The window runs over at most ``max_rows`` keys and sizes.
    """
    known = labels.filter(learned_from(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sizes = docs.groupBy(F.col("doc_id").alias("key")).agg(F.sum(F.octet_length(utf8("text"))).cast("long").alias("bytes")).filter(F.col("bytes") <= max_bytes // 16)
    first = sizes.join(known, sizes["key"] == known["doc_id"]).select("key", "bytes", "label", _order("key").alias("o")).orderBy("o", "key").limit(max_rows)
    upto = F.sum("bytes").over(Window.orderBy("o", "key").rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select(F.col("key").alias("__key"), "label")
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    return texts.join(F.broadcast(chosen), texts["key"] == chosen["__key"]).select("key", "text", "label")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labels of the rows that may be learned from."""
    return fit_ftrl(sampled(docs, labels, max_rows, max_bytes), max_rows=max_rows, **options)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    held_out = ~F.coalesce(learned_from(F.col("doc_id")), F.lit(True))
    return score_ftrl(docs, fit_toxicity(docs, labels, **options)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", bits: int = BITS, **options) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_toxicity(docs, labels, bits=bits, **options))
    small_batches(spark)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value, bits)
        for batch in batches:
            kept = [score(value.as_py() or b"") < threshold for value in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
