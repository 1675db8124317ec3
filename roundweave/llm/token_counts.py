"""Edit-aware token counts (operator 1).

A document's pre-tokens are kept in a segment tree: a leaf is a run of
pre-tokens, and every node holds the sums of characters and tokens under it. An
edit (start, end, replacement) re-encodes only the leaves it touches, and those
before it whose last pre-token looked at what the edit changed; the sums above
these leaves are updated. Encoding starts at a leaf's first character and goes
on until a pre-token begins where an old leaf beyond the edit begins; from there
on the old split holds, as the pattern looks ahead but never behind, and tokens
never cross pre-tokens. A leaf that has grown too large is split and the tree
above it is made anew from the sums, without encoding anything else.

Encoding is that of operator 8. The state of a document is its text and two arrays
(characters and tokens of its leaves). ``token_state`` makes a table of it, encoding each text once;
``update_tokens`` takes such a table with edits, encodes only what these touch, and gives the next
state. Places are found by descending the sums, from the root to a leaf.

Edge cases: a null text is an empty one; edits are taken in order of their start,
the ends of an edit are clipped to the text, and one that begins before the end
of the one before it is clipped to that; null edits change nothing; a null
replacement is empty; an empty table gives an empty table; repeated rows give
equal rows; other columns are not read, whatever their names; a state whose leaves are null or don't add up to its text is
made anew from the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from roundweave.llm.bpe import TABLE_ENTRIES, Codec, codec
from roundweave.llm.common import saved, small_batches, utf8

#: Pre-tokens of a leaf, and how many times that makes it split.
LEAF = 32
GROWN = 4
#: Characters behind a pre-token that can decide where it ends: the pattern's
#: longest contraction has three characters, and `\s+(?!\S)` looks at one.
LOOK_AHEAD = 3
EDITS = "array<struct<start:long,end:long,text:string>>"


class TokenCounts(dict):
    """Tokens of the pieces seen lately."""

    def __init__(self, encoder: Codec):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        n = len(self.encoder[piece]) // 4
        if len(piece) < 64:
            self[piece] = n
        return n


class CountTree:
    """Segment tree over the leaves of one document."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self._make(chars, tokens)
        self.encoded = 0  # pre-tokens encoded by edits

    def _make(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = max(1, len(chars))
        self.width = 1 << (self.leaves - 1).bit_length()
        sums = np.zeros((2, 2 * self.width), np.int64)
        sums[0, self.width : self.width + len(chars)] = chars
        sums[1, self.width : self.width + len(tokens)] = tokens
        at = self.width
        while at > 1:
            sums[:, at // 2 : at] = sums[:, at : 2 * at : 2] + sums[:, at + 1 : 2 * at : 2]
            at //= 2
        self.chars, self.tokens = sums[0].tolist(), sums[1].tolist()

    @classmethod
    def of(cls, text: str, counts: TokenCounts) -> CountTree:
        pieces = counts.encoder.split(text)
        if not pieces:
            return cls([], [])
        starts = np.arange(0, len(pieces), LEAF)
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), starts)
        tokens = np.add.reduceat(np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)), starts)
        return cls(chars.tolist(), tokens.tolist())

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold any text, to make the tree from again."""
        leaves = range(self.width, self.width + self.leaves)
        some = [i for i in leaves if self.chars[i]]
        return [self.chars[i] for i in some], [self.tokens[i] for i in some]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def begin_of(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, before = leaf + self.width, 0
        while node > 1:
            if node & 1:
                before += self.chars[node - 1]
            node //= 2
        return before

    def ended(self, at: int) -> int:
        """How many leaves end at this character or before it."""
        if at < 0:
            return 0
        node = 1
        while node < self.width:
            node *= 2
            if self.chars[node] <= at:
                at -= self.chars[node]
                node += 1
        return min(node - self.width + (self.chars[node] <= at), self.leaves)

    def edit(self, text: str, edits: list[tuple[int, int, str]], counts: TokenCounts) -> str:
        """Apply edits (sorted, apart) to ``text``, whose tree this is; the new text."""
        if not edits:
            return text
        parts, at, moved = [], 0, [0]
        for start, end, new in edits:
            parts += [text[at:start], new]
            at = end
            moved.append(moved[-1] + len(new) - (end - start))
        text = "".join([*parts, text[at:]])
        ends = [end for _, end, _ in edits]

        def begins_now(leaf: int) -> int:
            """Where a leaf begins in the new text, if no edit goes over its begin."""
            if leaf >= self.leaves:
                return len(text)
            begin = self.begin_of(leaf)
            return begin + moved[bisect_right(ends, begin)]

        touched: set[int] = set()
        for start, end, _ in edits:
            lo = min(self.ended(start - LOOK_AHEAD), self.leaves - 1)
            hi = min(1 + self.ended(end - 1), self.leaves) if end > 0 else 0
            touched.update(range(lo, max(lo + 1, hi)))
        changed: dict[int, tuple[list[int], list[int]]] = {}
        gone: list[int] = []
        after = 0
        for leaf in sorted(touched):
            if leaf < after:
                continue
            pos, after = begins_now(leaf) if leaf else 0, leaf + 1
            found = counts.encoder.pattern.finditer(text, pos)
            chars, tokens, next_begin = [], [], begins_now(after)
            while True:
                while after < self.leaves and (after in touched or next_begin < pos):
                    after += 1
                    next_begin = begins_now(after)
                if pos >= len(text) or (after < self.leaves and next_begin == pos):
                    break
                piece = next(found).group()
                chars.append(len(piece))
                tokens.append(counts[piece])
                pos += len(piece)
            if pos >= len(text):
                after = self.leaves
            changed[leaf] = (chars, tokens)
            self.encoded += len(chars)
            gone += range(leaf + 1, after)
        for leaf in gone:
            self.set(leaf, 0, 0)
        for leaf, (chars, tokens) in changed.items():
            self.set(leaf, sum(chars), sum(tokens))
        if any(len(c) > GROWN * LEAF for c, _ in changed.values()):
            self._split(changed)
        return text

    def _split(self, changed: dict[int, tuple[list[int], list[int]]]) -> None:
        """Split the leaves that were encoded anew, and make the tree above them."""
        chars, tokens = [], []
        for leaf in range(self.leaves):
            if leaf in changed:
                for k in range(0, len(changed[leaf][0]), LEAF):
                    chars.append(sum(changed[leaf][0][k : k + LEAF]))
                    tokens.append(sum(changed[leaf][1][k : k + LEAF]))
            elif self.chars[self.width + leaf]:
                chars.append(self.chars[self.width + leaf])
                tokens.append(self.tokens[self.width + leaf])
        self._make(chars, tokens)


def clipped(edits: Iterable | None, length: int) -> list[tuple[int, int, str]]:
    """Edits sorted, within the text and apart."""
    out, at = [], 0
    for e in sorted((e for e in edits or () if e and e["start"] is not None), key=lambda e: (e["start"], e["end"] or 0)):
        start = min(max(e["start"], at, 0), length)
        end = min(max(start, start if e["end"] is None else e["end"]), length)
        out.append((start, end, e["text"] or ""))
        at = end
    return out


LEAVES = StructType().add("leaf_chars", ArrayType(LongType())).add("leaf_tokens", ArrayType(LongType()))
ARRAY = pa.list_(pa.int64())


def token_state(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The key columns, ``text``, ``n_tokens``, ``leaf_chars`` and ``leaf_tokens`` of every document.

    One pass without a shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    keys = list(keys)
    out = StructType([*docs.select(*keys).schema.fields, StructField("text", StringType()), StructField("n_tokens", LongType()), *LEAVES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TokenCounts(codec(shared.value, pattern))
        for batch in batches:
            texts = [value.as_py().decode("utf-8", "replace") for value in batch.column(batch.num_columns - 1)]
            trees = [CountTree.of(body, counts) for body in texts]
            made = [pa.array(texts, pa.string()), pa.array([t.total for t in trees], pa.int64()), *(pa.array([t.kept()[i] for t in trees], ARRAY) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=out.names)

    return docs.select(*keys, utf8(text).alias("__text")).mapInArrow(run, out)


def update_tokens(state: DataFrame, rank_file: bytes, pattern: str, edits: Column, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The next state after edits, which is all that is encoded, and what has changed.

    ``state`` has the key columns, ``text``, ``leaf_chars`` and ``leaf_tokens``; ``edits`` is a
    column of type EDITS over it: places in code points. Returns these columns after the edits, and ``n_tokens`` (before), ``n_edits``,
    ``n_chars_edited`` and ``n_tokens_edited`` (after), and ``n_encoded`` (pre-tokens that the
    edits had encoded). One pass without a shuffle.
    """
    small_batches(state.sparkSession)
    shared = state.sparkSession.sparkContext.broadcast(rank_file)
    keys = list(keys)
    longs = ["n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_encoded"]
    out = StructType([*state.select(*keys).schema.fields, StructField("text", StringType()), *(StructField(n, LongType()) for n in longs), *LEAVES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TokenCounts(codec(shared.value, pattern))
        for batch in batches:
            rows = []
            for value, chars, tokens, edit in zip(*batch.columns[-4:]):
                body, chars, tokens = value.as_py().decode("utf-8", "replace"), chars.as_py(), tokens.as_py()
                whole = chars is not None and tokens is not None and len(chars) == len(tokens) and None not in chars and None not in tokens and sum(chars) == len(body)
                tree = CountTree(chars, tokens) if whole else CountTree.of(body, counts)
                before, changes = tree.total, clipped(edit.as_py(), len(body))
                body = tree.edit(body, changes, counts)
                rows.append((body, before, len(changes), len(body), tree.total, tree.encoded, *tree.kept()))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.string()] + [pa.int64()] * 5 + [ARRAY] * 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *made], names=out.names)

    return state.select(*keys, utf8("text").alias("__text"), "leaf_chars", "leaf_tokens", edits.cast(EDITS).alias("__edits")).mapInArrow(run, out)


def count_tokens(docs: DataFrame, rank_file: bytes, pattern: str, edits: Callable[[Column], Column], text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """What ``update_tokens`` returns for documents without a state: that is written to the shared folder first.

    ``edits`` makes the column of edits from that of the text.
    """
    state = saved(token_state(docs, rank_file, pattern, text, keys), "token_state")
    return update_tokens(state, rank_file, pattern, edits(state["text"]), keys)


def sample_edits(text: Column) -> Column:
    """Three edits a document, by its length: a deletion, a replacement and an addition at the end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def one(start: Column, size: int, new: str) -> Column:
        return F.struct(start.alias("start"), (start + size).alias("end"), F.lit(new).alias("text"))

    return F.array(one(F.floor(n / 3), 7, ""), one(F.floor(n / 2), 3, "2026 revised"), one(n, 0, "\n\nRevised text."))
