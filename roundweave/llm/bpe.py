"""Byte-level BPE encoding and decoding (operator 8).

A rank file is compiled into a finite-state transducer that is determinised
lazily. The underlying non-deterministic machine walks the trie of the
vocabulary: a hypothesis is (last whole token, node in the trie, tokens still
to be emitted). A hypothesis may close a token only if the merges leave that
token and the one before it apart when the two stand alone. At most one
hypothesis closes a token at any byte, so the set of live hypotheses is small,
and it empties of every false one at the latest after as many bytes as the
longest token has: the lookahead is bounded. What all live hypotheses agree on
is emitted at once. Sets of hypotheses are the deterministic states; a
transition is worked out the first time it is taken and kept in a bounded table.

Decoding is the reverse lookup, with the bytes passed through an incremental
UTF-8 state machine in blocks, so that a character may straddle two tokens or
two blocks.

Edge cases: a null text is an empty one (no tokens); an empty table gives an
empty table; equal rows give equal rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from roundweave.llm.common import CACHES, only_caches_of, small_batches, utf8

#: Entries after which a table of pieces or pairs, or one of transitions, is started afresh.
TABLE_ENTRIES = 400_000
TABLE_STEPS = 300_000
#: The usual pre-token pattern of byte-level BPE, and for texts whose letters are
#: all from Latin-1 the same split by the quicker engine. Fixed values.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile(rf"[^\x00-\x1b\x20-\x7f{LATIN}]")
#: Tokens that one step of the streaming decoder takes.
DECODE_BLOCK = 4096


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Bytes of each token, and its rank, from the text of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class MergeTransducer:
    """The transducer for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for piece, rank in ranks.items():
            node = 0
            for b in piece:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = rank
        self.half: dict[int, tuple[int, int] | None] = {}
        self.unmade: set[int] = set()
        self._forget()

    def _forget(self) -> None:
        """Start the lazily built tables afresh."""
        start = ((-1, 0, ()),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.ends: list[tuple[int, ...] | None] = [()]
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.apart: dict[int, bool] = {}

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """``data`` after all merges of ranks under ``below``, lowest first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte.

        A token that the merges never make has no halves and is ``unmade``.
        """
        known = self.half.get(token, 0)
        if known == 0:
            data = self.bytes_of[token]
            parts = self.merged(data, token)
            known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            if known is None and len(data) > 1:
                self.unmade.add(token)
            self.half[token] = known
        return known

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the merges, run on the two tokens side by side, leave these two.

        Their latest merges are undone one by one, the later first. They do not
        stay apart if a pair across the border has a rank by which it would have
        been merged before the merge just undone. What is found is kept in ``apart``;
        a left token of -1 is the begin of the piece.
        """
        self.halves(right)
        known = right not in self.unmade and (left < 0 or self._apart(left, right))
        self.apart[left << 20 | right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        bytes_of, rank, half, first = self.bytes_of, self.ranks.get, self.half.get, len(self.ranks) + 1
        while True:
            if rank(bytes_of[left] + bytes_of[right], first) < first:
                return False
            of_left, of_right = half(left, 0), half(right, 0)
            if of_left == 0:
                of_left = self.halves(left)
            if of_right == 0:
                of_right = self.halves(right)
            if of_left and (left > right or not of_right):
                first, left = left, of_left[1]
            elif of_right:
                first, right = right + 1, of_right[0]
            else:
                return True

    def _expand(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        trie, tokens, apart = self.next, self.token, self.apart
        live, closed = [], None
        for last, node, pending in self.states[state]:
            to = trie[node].get(byte)
            if to is None:
                continue
            if trie[to]:
                live.append((last, to, pending))
            token = tokens[to]
            if token >= 0 and closed is None:
                leaves = apart.get(last << 20 | token)
                if leaves if leaves is not None else self.stays_apart(last, token):
                    closed = (*pending, token)
        if closed is not None:
            live.append((closed[-1], 0, closed))
        first = live[0][2]
        agreed = len(first)
        if agreed:
            for _, _, pending in live:
                while pending[:agreed] != first[:agreed]:
                    agreed -= 1
            if agreed:
                live = [(last, node, pending[agreed:]) for last, node, pending in live]
        key = tuple(live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.ends.append(None if closed is None else closed[agreed:])
        self.step[state << 8 | byte] = made = (to, first[:agreed])
        return made

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. A piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.step) > TABLE_STEPS or len(self.apart) > TABLE_ENTRIES:
            self._forget()
        state, out, step = 0, [], self.step
        for b in piece:
            key = state << 8 | b
            state, emitted = step[key] if key in step else self._expand(state, b)
            if emitted:
                out += emitted
        return out + list(self.ends[state])


class Codec(dict):
    """Encodes and decodes texts. As a dict: packed ids of the pieces seen lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.pattern = regex.compile(pattern)
        self.any_split = self.pattern.findall
        self.latin = pattern == GPT2_PATTERN
        self.transducer = MergeTransducer(ranks)
        self.token_bytes = self.transducer.bytes_of
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece) or self._run(piece)
        if len(self) > TABLE_ENTRIES:  # two generations: what is still in use moves on
            self.older = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = packed
        return packed

    def _run(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if self.latin and NOT_LATIN.search(text) is None:
            return LATIN_SPLIT.findall(text)
        return self.any_split(text)

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> Iterator[str]:
        """The text of packed ids, block by block."""
        utf8_machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.frombuffer(packed, "<u4")
        for i in range(0, len(ids), DECODE_BLOCK):
            block = b"".join(map(self.token_bytes.__getitem__, ids[i : i + DECODE_BLOCK].tolist()))
            yield utf8_machine.decode(block)
        yield utf8_machine.decode(b"", final=True)


_codecs: dict[tuple, Codec] = {}
CACHES["bpe"] = _codecs.clear


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this worker process for a rank file; made once.

    Its tables hold no cycles, so the collector of cycles need not go through them often.
    """
    only_caches_of("bpe")
    key = (hash(rank_file), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(rank_file), pattern)
        gc.freeze()
        gc.set_threshold(100_000, 50, 100)
    return _codecs[key]


def bpe_encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keys: Iterable[str] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    ``rank_file`` is the content of a rank file; its size is that of the
    vocabulary, so it is broadcast. Returns the key columns, ``n_tokens``, and
    ``token_ids`` (array of int) with ``decoded`` (string); with ``digests``
    the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded
    bytes instead. One pass without a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(rank_file)
    keys = list(keys)
    out = docs.select(*keys).schema
    out.add("n_tokens", "long")
    if digests:
        out.add("ids_sha256", "string").add("decoded_sha256", "string")
    else:
        out.add("token_ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(shared.value, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(batch.num_columns - 1):
                packed = it.encode(value.as_py().decode("utf-8", "replace"))
                counts.append(len(packed) // 4)
                if digests:
                    back = hashlib.sha256()
                    for part in it.decode(packed):
                        back.update(part.encode())
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(back.hexdigest())
                else:
                    ids.append(np.frombuffer(packed, "<i4"))
                    decoded.append("".join(it.decode(packed)))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select(*keys, utf8(text).alias("__text")).mapInArrow(run, out)
