"""Quality rules from suffix-array repetition (operator 3).

A document's marks (runs of letters, digits and underscores, and every other
character that is not white space) are put into a suffix array. Neighbours in it have a
longest common prefix; the intervals of these prefixes are the repeated
substrings, and a suffix's longest repeat is the larger of its two neighbouring
prefixes. The spans of all repeats of ``MIN_MARKS`` marks or more are united. A
document is dropped if the union covers more than ``MAX_FRACTION`` of its characters (white space left out),
or if one repeat has more than ``MAX_REPEAT`` marks. Punctuation counts, so runs of
symbols, tables of dashes and loops of few words are repeats though no five words repeat.

The limits come from labelled documents: of those that pass the base rule, repeats of three marks cover at most a
quarter where the label says good, and two fifths in the median where it says bad.

The base rule counts words in 5-word windows found twice, by a suffix array of words.

The arrays of the documents of an Arrow batch are built together by prefix
doubling in numpy: the first rank of a mark holds its document, so no repeat
crosses documents, and only suffixes that are not told apart yet are sorted
again. One pass without a shuffle; memory follows ``BATCH_WORDS`` or the
longest text, times the logarithm of its longest repeat.

Edge cases: a null text has no words, and fails the rule on short texts; so does an
empty one; repeated rows give equal rows; a null key stays null; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roundweave.llm.common import small_batches, utf8

WORD = re.compile("[^\x20\x09-\x0d]+")
MARK = re.compile(r"\w+|[^\w\s]")
SYMBOLS = "#*$%&|<>"
#: Words of the windows of the base rule.
WINDOW = 5
#: Marks of the shortest repeat that counts.
MIN_MARKS = 3
#: The most of a text's characters that repeats may cover, and the marks that one repeat may have.
MAX_FRACTION = 0.3
MAX_REPEAT = 50
#: Words of the texts whose suffixes are sorted together, unless one text has more.
BATCH_WORDS = 200_000


def suffix_array(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence of ints, and the common prefix of each suffix with the one before it.

    The last item must differ from all others, and so must the last item of each
    of several sequences put together here.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.r_[True, first[order][1:] != first[order][:-1]]
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    levels, step = [rank], 1
    sizes = np.diff(np.r_[starts, n])
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        one, two = rank[open_], rank[np.minimum(open_ + step, n - 1)]
        by = np.argsort(one.astype(np.int64) * (n + 1) + two, kind="stable")
        open_, one, two = open_[by], one[by], two[by]
        new_one = np.r_[True, one[1:] != one[:-1]]
        new_two = new_one | np.r_[True, two[1:] != two[:-1]]
        at = np.arange(len(open_))
        begin_one = np.maximum.accumulate(np.where(new_one, at, 0))
        begin_two = np.maximum.accumulate(np.where(new_two, at, 0))
        rank = rank.copy()
        rank[open_] = one + (begin_two - begin_one)
        levels.append(rank)
        starts = np.flatnonzero(new_two)
        sizes = np.diff(np.r_[starts, len(open_)])
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b, length = array[pairs - 1], array[pairs], np.zeros(len(pairs), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        same = (np.maximum(x, y) < n) & (levels[i][np.minimum(x, n - 1)] == levels[i][np.minimum(y, n - 1)])
        length += same * (1 << i)
    common[pairs] = length
    return array, common


def longest_repeats(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For every word of several documents, put together with a gap after each, the
    longest repeat within the document that starts there; and where documents start."""
    lengths = np.array([len(d) for d in docs])
    starts = np.r_[0, np.cumsum(lengths + 1)]
    words = np.empty(starts[-1], np.int64)
    for d, s in zip(docs, starts):
        words[s : s + len(d)] = d
    ends = starts[1:] - 1
    words[ends] = 0
    most = int(words.max(initial=0)) + 2
    doc = np.repeat(np.arange(len(docs)), lengths + 1)
    words += doc * most
    words[ends] = np.arange(len(docs)) * most + most - 1
    array, common = suffix_array(words)
    best = np.maximum(common, np.r_[common[1:], 0])
    repeat = np.empty(len(words), np.int64)
    repeat[array] = best
    return repeat, starts


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least so many words."""
    at = np.flatnonzero(repeat >= least)
    edges = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + repeat[at], -1)
    return np.cumsum(edges[:-1]) > 0


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_fraction double, longest_repeat long, repeats array<struct<start:long,end:long>>")


def _numbered(texts: list[list[str]]) -> list[list[int]]:
    """Strings as numbers, the same for the same string.

    Nothing here refers to itself: a dictionary in a cycle would stay, with all its strings, until a full garbage
    collection, which many strings and few containers don't bring about.
    """
    ids: defaultdict[str, int] = defaultdict(count().__next__)
    return [list(map(ids.__getitem__, text)) for text in texts]


def _spans(text: str, inside: np.ndarray) -> list[dict[str, int]]:
    """Runs of marks that lie in repeats, as places in code points."""
    if not inside.any():
        return []
    at = np.array([m.span() for m in MARK.finditer(text)])
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return [{"start": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in zip(edges[::2], edges[1::2])]


def measure(texts: list[str], spans: bool = True) -> list[tuple]:
    """The values of FIELDS for each text; the spans are those of the united repeats, in code points."""
    words = list(map(WORD.findall, texts))
    in_words, word_starts = longest_repeats(_numbered(words))
    in_windows = covered(in_words, WINDOW)
    marks = list(map(MARK.findall, texts))
    repeat, starts = longest_repeats(_numbered(marks))
    inside = covered(repeat, MIN_MARKS)
    out = []
    for text, w, ws, of, s in zip(texts, words, word_starts, marks, starts):
        n, n_repeat = len(w), int(in_windows[ws : ws + len(w)].sum())
        mine = inside[s : s + len(of)]
        size = np.fromiter(map(len, of), np.int64, len(of))
        fraction = float(size[mine].sum() / size.sum()) if len(of) else 0.0
        longest = int(repeat[s : s + len(of)].max(initial=0))
        failed = n < 10 or 100 * n_repeat > 20 * n
        kept = not failed and fraction <= MAX_FRACTION and longest <= MAX_REPEAT
        row = (n, sum(map(len, w)), sum(map(text.count, SYMBOLS)), _dup_lines(text), n_repeat, failed, kept, fraction, longest)
        out.append((*row, _spans(text, mine)) if spans else row)
    return out


def quality(docs: DataFrame, text: str = "text", keys: Iterable[str] = ("doc_id",), spans: bool = True) -> DataFrame:
    """The key columns and FIELDS (with ``spans`` the last one too) for every whole text."""
    keys = list(keys)
    kinds = {f.name: f.dataType for f in docs.select(*keys).schema}
    fields = FIELDS if spans else FIELDS[: FIELDS.index(", repeats")]
    schema = f"{', '.join(f'`{k}` {t.simpleString()}' for k, t in kinds.items())}, {fields}"
    made_kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = [f.split()[0] for f in fields.replace("struct<start:long,end:long>", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, words = [], [], 0
            for value in batch.column(batch.num_columns - 1):
                held.append(value.as_py().decode("utf-8", "replace"))
                words += len(held[-1]) // 5
                if words >= BATCH_WORDS:
                    rows += measure(held, spans)
                    held, words = [], 0
            rows += measure(held, spans) if held else []
            made = [pa.array([r[i] for r in rows], kind) for i, kind in zip(range(len(names)), made_kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keys, *names])

    small_batches(docs.sparkSession)
    return docs.select(*keys, utf8(text).alias("__text")).mapInArrow(run, schema)
