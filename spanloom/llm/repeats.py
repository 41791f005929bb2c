"""Removal of repeated passages by suffix arrays over candidates.

A byte goes if a string of `length` bytes that covers it also starts earlier. Two equal strings of
that length have the same anchor: the least hash (leftmost of equals) among the `GRAM`-byte grams in
them, at the same offset. Each anchor owns a run of consecutive start positions; the bytes that their
strings span are the anchor's context. So the table needs one row per anchor (about one in 35 bytes),
and strings can only be equal if their anchors' grams are.

1. Anchor grams that occur once are left out: strings there are unique.
2. Equal contexts are put together (their first occurrence keeps the bytes).
3. Where one gram has several different contexts, these are cut to what they share, put together where
   that makes them equal, and the rest are suffix-sorted together (`suffixes`):
   start positions whose suffixes agree in `length` bytes are neighbours in the order, and all but
   the earliest are repeats. Grams with more than `HOT_CONTEXTS` contexts, which no single task should
   sort, go by a 128-bit digest of each string in a group-by that is combined before the shuffle.
4. The runs to remove are united per document.

Steps 1 and 2 compare 64-bit hashes of contexts together with 64-bit hashes of their grams; the suffix
sort works on the bytes. Texts travel compressed and only those of documents with candidates travel
at all after the first join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SLICE_BYTES, Tables, batch_of, partitions, pieces, ready, strings
from spanloom.llm.suffixes import suffix_array

LENGTH, GRAM = 100, 32
HOT_CONTEXTS = 4096
PASSES = 3  # in which all anchors meet
SORT_BYTES = 32 << 10  # contexts of whole grams that are sorted together
WHOLE = 1 << 16  # runs of whole contexts that are put out together
STRETCH = 1 << 22  # bytes of a text whose anchors are found at a time
ODD, ODD_2, MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any stretch of a text, modulo 2**64, from running sums."""

    def __init__(self, base: int, n: int) -> None:
        self.up = _powers(base, n)
        self.down = _powers(pow(base, -1, 1 << 64), n)
        self.values = np.random.default_rng(base).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.__init__(pow(int(self.up[1]), 1, 1 << 64), 2 * len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.down[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.up[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, grams: Hasher, contexts: Hasher, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """gram hash, context hash, first and last start position of each anchor of a text."""
    found = []
    for begin in range(0, max(1, len(data) - length + 1), STRETCH):
        part = data[begin : begin + STRETCH + length - 1]
        if len(part) < length:
            break
        sums = grams.sums(part)
        at = np.arange(len(part) - gram + 1)
        hashes = grams.of(sums, at, at + gram)
        # The place in the low bits: of equal hashes, the leftmost is the least.
        ordered = (hashes & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        chosen = (_sliding_min(ordered, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        high = np.append(low[1:], len(chosen)) - 1
        span = contexts.of(contexts.sums(part), low, high + length)
        found.append((hashes[chosen[low]], span, low + begin, high + begin))
    if not found:
        return tuple(np.zeros(0, dtype=kind) for kind in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, spans = Hasher(ODD, 1 << 17), Hasher(ODD_2, 1 << 17)
        for batch in pieces(batches, "text"):
            found = [anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), grams, spans, length, gram) for text in strings(batch, "text")]
            h, c, low, high = (np.concatenate(x) for x in zip(*found))
            each = np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found])
            numbers = [h.view(np.int64), c.view(np.int64), low.astype(np.int32), high.astype(np.int32)]
            columns = [*map(pa.array, numbers), batch.column(1).take(pa.array(each)), batch.column(2).take(pa.array(each))]
            yield pa.RecordBatch.from_arrays(columns, names=["_gram", "_span", "_low", "_high", "_row", "_doc"])

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "text"):
        data = [press.compress(text.encode("utf-8", "surrogatepass")) for text in strings(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(data, type=pa.binary())], names=["_row", "_data"])


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _contexts(length: int):
    """Rows (_data, wanted) with the contexts cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_gram", pa.int64()), ("_n", pa.int64()), ("_doc", pa.int64()), ("_row", pa.int64()), ("_low", pa.int32()), ("_bytes", pa.binary())])
        out: list[list] = [[], [], [], [], [], []]
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                text = _open(row["_data"])
                for w in row["_wanted"]:
                    data = text[w["_low"] : w["_high"] + length]
                    for column, value in zip(out, (w["_gram"], w["_n"], row["_doc"], row["_row"], w["_low"], data)):
                        column.append(value)
                    size += len(data)
                if size > SLICE_BYTES:
                    yield batch_of(schema, *out)
                    out, size = [[], [], [], [], [], []], 0
        if out[0]:
            yield batch_of(schema, *out)

    return run


def repeated_starts(contexts: list[tuple[tuple, bytes]], length: int) -> list[tuple[int, int]]:
    """Of contexts (first occurrence as a comparable place, bytes), the (context, offset) of each
    start of `length` bytes that also start at an earlier place: suffix-sorted, equal starts are
    neighbours."""
    joined = b"\x00".join(data for _, data in contexts)
    owner, offset = [], []
    for number, (_, data) in enumerate(contexts):
        # The separator and the last length - 1 bytes of a context start no string of it.
        starts = len(data) - length + 1
        owner += [number] * starts + [-1] * length
        offset += [*range(starts), *([0] * length)]
    found, group, before = [], [], None

    def close():
        if len(group) > 1:
            places = [(contexts[owner[p]][0][:-1] + (contexts[owner[p]][0][-1] + offset[p],), p) for p in group]
            first = min(places)[0]
            found.extend((owner[p], offset[p]) for place, p in places if place != first)

    for p in suffix_array(joined):
        if owner[p] < 0:
            continue
        string = joined[p : p + length]
        if string != before:
            close()
            group, before = [], string
        group.append(p)
    close()
    return found


SPANS = pa.schema([("_row", pa.int64()), ("_low", pa.int32()), ("_high", pa.int32())])
SPAN_COLUMNS = "_row bigint, _low int, _high int"


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def _reach(sides: list[bytes]) -> list[int]:
    """For each string, the longest prefix that it shares with any other: its neighbours in order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in pairwise(order):
        shared = _common(sides[i], sides[j])
        out[i], out[j] = max(out[i], shared), max(out[j], shared)
    return out


def trimmed(contexts: list[tuple[tuple, bytes]], gram: bytes, length: int) -> list[tuple[tuple, bytes]]:
    """Contexts of one gram, cut to what each shares with any other to both sides of the gram. What
    is left out lies in no string of `length` bytes that occurs twice."""
    at = [data.find(gram) for _, data in contexts]
    right = _reach([data[a:] for a, (_, data) in zip(at, contexts)])
    left = _reach([data[:a][::-1] for a, (_, data) in zip(at, contexts)])
    out = []
    for a, before, after, (place, data) in zip(at, left, right, contexts):
        if before + after >= length:
            out.append(((*place[:-1], place[-1] + a - before), data[a - before : a + after]))
    return out


def _sorted_groups(length: int, gram_bytes: int, sort_bytes: int):
    """Rows (_gram, _doc, _row, _low, _bytes) sorted by gram: the spans of repeated starts. Groups are
    gathered until they are worth a sort; a group is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Hasher(ODD, 1 << 10)
        held: list[tuple[tuple, bytes]] = []
        whole: list[list[int]] = []
        group: list[tuple[tuple, bytes]] = []
        size, gram = 0, None

        def found_gram() -> bytes:
            data = group[0][1]
            at = np.arange(len(data) - gram_bytes + 1)
            hashes = grams.of(grams.sums(np.frombuffer(data, dtype=np.uint8)), at, at + gram_bytes).view(np.int64)
            first = int(np.flatnonzero(hashes == gram)[0])
            return data[first : first + gram_bytes]

        def close() -> int:
            if len(group) < 2:
                return 0
            # What is equal after the cut is put together like equal contexts: the earliest is sorted.
            first: dict[bytes, tuple] = {}
            for place, data in sorted(trimmed(group, found_gram(), length)):
                if first.setdefault(data, place) != place:
                    whole.append([place[1], place[2], place[2] + len(data) - length])
            if len(first) < 2:
                return 0
            held.extend((place, data) for data, place in first.items())
            return sum(len(data) + 1 for data in first)

        def spans():
            runs, last = whole.copy(), None
            for number, at in sorted(repeated_starts(held, length)) if held else []:
                _, row, low = held[number][0]
                if last == (number, at - 1):
                    runs[-1][2] = low + at
                else:
                    runs.append([row, low + at, low + at])
                last = number, at
            held.clear()
            whole.clear()
            return batch_of(SPANS, [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs])

        for batch in batches:
            for g, doc, row, low, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if g != gram:
                    size += close()
                    group.clear()
                    if size > sort_bytes or len(whole) > WHOLE:
                        yield spans()
                        size = 0
                gram = g
                # A null doc_id is before all others.
                group.append((((doc is not None, doc or 0), row, low), data))
        close()
        if held or whole:
            yield spans()

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_string", pa.binary()), ("_doc", pa.int64()), ("_row", pa.int64()), ("_low", pa.int32())])
        for batch in batches:
            for doc, row, low, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                n = len(data) - length + 1
                digests = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                yield batch_of(schema, digests, [doc] * n, [row] * n, [low + i for i in range(n)])

    return run


def _cut(length: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        out: list[list] = [[], [], [], [], []]
        for batch in batches:
            for row in batch.to_pylist():
                text, spans = _open(row["_data"]), []
                for low, high in sorted((s["_low"], s["_high"] + length) for s in row["_spans"]):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                kept, at = [], 0
                for low, high in spans:
                    kept.append(text[at:low])
                    at = high
                kept = b"".join([*kept, text[at:]])
                values = (row["_row"], len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts_too else None)
                for column, value in zip(out, values):
                    column.append(value)
            if out[0]:
                yield batch_of(schema, *out)
                out = [[], [], [], [], []]

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, sort_bytes: int = SORT_BYTES, texts_too: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256, and `kept` (the bytes that stay) where asked for and something was removed.

    Texts are UTF-8 bytes, null is empty; strings never cross documents. Earlier means a smaller
    doc_id (null first), of rows that repeat one the row read first, in a row the smaller position.
    Strings are judged on the input. An empty table gives no rows.
    """
    if not 0 < gram <= length:
        raise ValueError("a string must hold a gram")
    ready(docs.sparkSession, broadcasts=False)
    tables = Tables(docs.sparkSession)
    settle, drop = tables.settle, tables.drop
    # Stored with the texts: numbers derived again in a later job differ if the files are split otherwise.
    read = settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    text = F.coalesce("text", F.lit(""))
    facts = settle(read.select("doc_id", "_row", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("_sha")), "text-facts")
    texts = read.select("text", "_row", F.col("doc_id").alias("_doc"))
    rows = settle(texts.mapInArrow(_anchor_rows(length, gram), "_gram bigint, _span bigint, _low int, _high int, _row bigint, _doc bigint"), "all-anchors")
    # Pass by pass, so that only a part of all anchors is on its way at a time.
    passes = []
    for i in range(PASSES):
        mine = rows.filter(F.pmod(F.col("_gram"), F.lit(PASSES)) == i)
        shared = settle(mine.groupBy("_gram").count().filter("count > 1").select("_gram"), "shared-grams")
        passes.append(settle(mine.join(shared, "_gram"), f"anchors-{i}"))
        drop("shared-grams")
    rows = reduce(DataFrame.unionByName, passes)
    drop("all-anchors")
    squeezed = texts.select("text", "_row").mapInArrow(_squeezed, "_row bigint, _data binary")
    held = settle(squeezed.join(rows.select("_row").distinct(), "_row"), "candidate-texts")
    drop("numbered-texts")

    place = F.struct(F.col("_doc").isNotNull().alias("known"), "_doc", "_row", "_low", "_high")
    spans = settle(rows.groupBy("_gram", "_span").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_times")), "contexts")
    several = spans.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Every occurrence of a context but the first is a repeat as a whole.
    firsts = spans.filter("_times > 1").select("_gram", "_span", "_first._row", "_first._low").toDF("_gram", "_span", "_first_row", "_first_low")
    later = rows.join(firsts, ["_gram", "_span"]).filter("_row <> _first_row OR _low <> _first_low").select("_row", "_low", "_high")
    later = settle(later, "later-contexts")
    drop(*[f"anchors-{i}" for i in range(PASSES)])

    candidates = spans.join(several, "_gram").select("_gram", "_n", "_first.*")
    wanted = candidates.groupBy("_row", "_doc").agg(F.collect_list(F.struct("_gram", "_n", "_low", "_high")).alias("_wanted"))
    cut = wanted.join(held, "_row").select("_row", "_doc", "_data", "_wanted")
    cut = settle(cut.mapInArrow(_contexts(length), "_gram bigint, _n bigint, _doc bigint, _row bigint, _low int, _bytes binary"), "context-bytes")
    drop("contexts")
    columns = ["_gram", "_doc", "_row", "_low", "_bytes"]
    # A stated number of parts: few bytes, but much to do for each.
    by_sort = cut.filter(F.col("_n") <= hot_contexts).select(*columns).repartition(2 * partitions(docs.sparkSession), "_gram")
    by_sort = by_sort.sortWithinPartitions("_gram").mapInArrow(_sorted_groups(length, gram, sort_bytes), SPAN_COLUMNS)
    hot = cut.filter(F.col("_n") > hot_contexts).select(*columns).mapInArrow(_strings(length), "_string binary, _doc bigint, _row bigint, _low int")
    where = F.struct(F.col("_doc").isNotNull().alias("known"), "_doc", "_row", "_low")
    hot = settle(hot, "hot-strings")
    first = settle(hot.groupBy("_string").agg(F.min(where).alias("_first")), "hot-firsts")
    # One row per string on either side; where it is the first, the span is null and is not collected.
    later_one = (F.col("_row") != F.col("_first._row")) | (F.col("_low") != F.col("_first._low"))
    by_string = hot.join(first, "_string").select("_row", F.when(later_one, F.struct("_low", F.col("_low").alias("_high"))).alias("_at"))

    every = later.unionByName(by_sort).select("_row", F.struct("_low", "_high").alias("_at")).unionByName(by_string)
    every = settle(every.groupBy("_row").agg(F.collect_list("_at").alias("_spans")), "repeat-spans")
    drop("later-contexts", "context-bytes", "hot-strings", "hot-firsts")
    removed = every.join(held, "_row").select("_row", "_data", "_spans").mapInArrow(_cut(length, texts_too), "_row bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    none = F.lit(0).cast("bigint")
    return facts.join(removed, "_row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), "kept"
    )
