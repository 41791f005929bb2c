"""Periodic runs of words: stretches that repeat themselves with a smallest period.

A run is found by its last square. In the enhanced suffix array of the words (suffix array, its
inverse and the lengths of common prefixes), a square of period p whose next word breaks the period
is a pair of suffixes i and i + p in different children of an LCP interval of depth p. Each boundary
of the array splits such an interval; the suffixes of the smaller side look up the inverse at
i + depth and i - depth and ask whether it lies on the other side. No tree nodes are built. Squares
are then rotated to the left as far as the period holds, and those that cover the same stretch are
merged into one run with the smallest period.

The suffix array is that of many documents side by side: a document's number leads every word, so
suffixes of different documents are never compared. It is sorted by doubling; the ranks of each
length 2^k are kept, and give common prefixes and rotations by comparing blocks.

At scale: documents are worked on where they are read, without a shuffle, in slices of a few MiB.
A run of `least` words shares least / 2 words with itself one period on, so a document in
which no stretch of that length occurs twice has no run and is done after one sort of hashes. Memory is that of a slice, or
of one document if it is longer: about 4 bytes x log2(longest repeat) a word beside some 100 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import pieces, ready

LEAST = 12
CHUNK = 1 << 21  # suffixes that look up their partners at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (cut at ASCII white space), and how many each text has; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = lists.flatten()
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    real = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at the ends gives empty words
    if not real.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        words = words.filter(pa.array(real))
    return words, counts


def with_repeats(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The documents in which some `width` words in a row occur twice. Decided by hashes: others can
    be among them, none is missing."""
    if len(ids) < width:
        return np.zeros(0, dtype=np.int64)
    last = len(ids) - width + 1
    found = doc[:last].astype(np.uint64) * MIX
    for k in range(width):
        found = (found ^ (found >> np.uint64(29)) ^ ids[k : k + last].astype(np.uint64)) * MIX
    inside = np.flatnonzero(doc[:last] == doc[width - 1 :])
    order = inside[np.argsort(found[inside], kind="stable")]
    return np.unique(doc[order[1:][found[order[1:]] == found[order[:-1]]]])


class SuffixArray:
    """Suffixes of the words `ids` within their documents (`doc` ascending): `order`, its inverse
    `place`, and `common`, the words that the k-th suffix shares with the one before it."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray) -> None:
        n = len(ids)
        key = doc.astype(np.int64) << 32 | ids.astype(np.int64)
        self.order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
        until = np.repeat(ends, np.diff(np.append(0, ends)))  # the end of each word's document
        fresh = np.append(True, key[self.order[1:]] != key[self.order[:-1]])
        rank = np.empty(n, dtype=np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels, inner = [], []
        width = 1
        while True:
            self.levels.append(rank.copy())
            tied = ~fresh
            inner.append(np.flatnonzero(tied))
            tied[:-1] |= tied[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = self.order[slots]
            ahead = at + width
            follow = np.where(ahead < until[at], rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.int64)
            key = rank[at].astype(np.int64) << 32 | follow
            sorting = np.argsort(key, kind="stable")
            key, at = key[sorting], at[sorting]
            # Groups keep their slots; within a group, what follows decides.
            self.order[slots] = at
            parted = np.append(True, key[1:] != key[:-1])
            fresh[slots] |= parted
            rank[at] = np.maximum.accumulate(np.where(fresh[slots], slots, 0))
            width *= 2
        self.place = rank
        self.common = np.zeros(n, dtype=np.int32)
        for level in range(len(self.levels) - 1, -1, -1):
            k, ranks = inner[level], self.levels[level]
            x, y = self.order[k - 1] + self.common[k], self.order[k] + self.common[k]
            near = (x < n) & (y < n)
            same = near & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)]) & (x != y)
            self.common[k[same]] += 1 << level

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """For each boundary k: the interval's first suffix on the left, and the end of its part on
        the right, which stops at the next boundary of the same depth."""
        common = self.common.tolist()
        left, right = [0] * len(common), [len(common)] * len(common)
        stack = []
        for k, depth in enumerate(common):
            while stack and common[stack[-1]] >= depth:
                right[stack.pop()] = k
            left[k] = stack[-1] if stack else 0
            stack.append(k)
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of each square after which the period breaks."""
        left, right = self.intervals()
        n = len(self.order)
        k = np.flatnonzero(self.common)
        less = k - left[k] <= right[k] - k  # the left side is the smaller one
        begin, size = np.where(less, left[k], k), np.where(less, k - left[k], right[k] - k)
        low, high = np.where(less, k, left[k]), np.where(less, right[k], k)
        depth = self.common[k].astype(np.int64)
        total = np.cumsum(size)
        starts, periods = [], []
        at = 0
        while at < len(k):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK)))
            some = slice(at, stop)
            each = np.repeat(np.arange(at, stop), size[some])
            offset = np.arange(len(each)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            suffix = self.order[begin[each] + offset]
            for step in (depth[each], -depth[each]):
                other = suffix + step
                inside = np.flatnonzero((other >= 0) & (other < n))
                where, which = self.place[other[inside]], each[inside]
                hit = inside[(where >= low[which]) & (where < high[which])]
                starts.append(np.minimum(suffix[hit], other[hit]))
                periods.append(depth[each[hit]])
            at = stop
        return np.concatenate(starts or [k]), np.concatenate(periods or [k])


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in `ids`), length and period of all runs of `least` words or more, by start and period.
    `doc` ascends; no run leaves its document."""
    empty = np.zeros(0, dtype=np.int64)
    if not len(ids):
        return empty, empty, empty
    array = SuffixArray(ids, doc)
    start, period = array.squares()
    end = start + 2 * period
    first = np.searchsorted(doc, doc[start])  # of the document
    for level in range(len(array.levels) - 1, -1, -1):
        ranks, back = array.levels[level], start - (1 << level)
        fits = np.flatnonzero(back >= first)
        same = fits[ranks[back[fits]] == ranks[back[fits] + period[fits]]]
        start[same] = back[same]
    keep = np.flatnonzero(end - start >= np.maximum(least, 2 * period))
    keep = keep[np.lexsort((period[keep], end[keep], start[keep]))]
    start, end, period = start[keep], end[keep], period[keep]
    one = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, dtype=bool)
    start, end, period = start[one], end[one], period[one]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def _lists(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int64())


def _collapse(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            words, counts = split_words(batch.column(0))
            ids = np.asarray(words.dictionary_encode().indices)
            doc = np.repeat(np.arange(len(counts)), counts)
            begins = np.cumsum(counts) - counts
            chosen = np.zeros(len(counts), dtype=bool)
            chosen[with_repeats(ids, doc, max(1, least // 2))] = True
            spots = np.flatnonzero(chosen[doc])
            start, length, period = find_runs(ids[spots], doc[spots], least)
            start = spots[start]
            # A word goes if some run holds it after its first period.
            edges = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edges, start + period, 1)
            np.add.at(edges, start + length, -1)
            kept = np.cumsum(edges[:-1]) == 0
            left = pa.LargeListArray.from_arrays(_lists(np.bincount(doc[kept], minlength=len(counts))), words.filter(pa.array(kept)))
            rows = pa.StructArray.from_arrays([pa.array(start - begins[doc[start]]), pa.array(length.astype(np.int64)), pa.array(period.astype(np.int64))], names=["start", "length", "period"])
            offsets = _lists(np.bincount(doc[start], minlength=len(counts))).cast(pa.int32())
            found = [pa.array(counts), pa.ListArray.from_arrays(offsets, rows), pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=[*batch.schema.names[1:], "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The columns `keep`, and n_words, runs and collapsed, per row of `docs`.

    `runs` are all stretches of `least` words or more, and two periods or more, with their first word's
    number, their length and smallest period, by start and period; no neighbouring word extends one.
    `collapsed` are the words (cut at ASCII white space) that no run holds after its first period, joined
    by one space. Null and empty texts have no words, no runs and an empty text. Rows that repeat are
    worked on one by one, an empty table gives none; other columns are ignored, whatever their names.
    """
    ready(docs.sparkSession)
    taken = docs.select(docs[text].alias("_text"), *keep)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return taken.mapInArrow(_collapse(least), f"{types}n_words bigint, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run with the greatest length (then the smallest start and period), or null."""
    ranked = F.transform(runs, lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))
    best = F.array_min(ranked)
    return F.when(best.isNotNull(), F.struct(best.start.alias("start"), (-best.less).alias("length"), best.period.alias("period")))
