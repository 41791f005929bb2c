"""What each filter removes, alone and after the others, by sorted posting lists.

Rows are numbered, and a part's rows are cut into ranges of ids. For each part and range the ids that
fail a filter are kept as one sorted list per filter, beside lists of the rows that carry a mark (a
label, say). What a set of filters removes is the union of their lists; what one more removes is its
list less that union. Both are merges of sorted lists that gallop: a stretch of one list below the
next list's head is found by doubling steps and taken whole. Sizes are summed over the ranges, and
every order of the filters is read from the sizes by set of filters before.

At scale: a list is bounded by its range, so a part that holds most rows is as many groups as any
other rows. The texts are read once; later steps move ids. Of equal texts the first is found by a
minimum combined before the shuffle, and rows are compared with it by (digest, doc_id), so that a
large group of copies meets in no one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import batch_of, pieces, ready, settled, strings

RANGE = 1 << 13
FILTERS, MARKS = "ABCDE", ("good", "toxic")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words; per cent of words; per cent of characters
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def gallop(ids: list[int], value: int, at: int) -> int:
    """The first place from `at` on whose id is `value` or more, by doubling steps."""
    step, n = 1, len(ids)
    while at + step < n and ids[at + step] < value:
        step *= 2
    return bisect_left(ids, value, at + step // 2, min(at + step + 1, n))


def union(lists: list[list[int]]) -> list[int]:
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    found: list[int] = []
    while heads:
        value, k, at = heads[0]
        ids = lists[k]
        stop = gallop(ids, min(heads[1:3])[0], at) if len(heads) > 1 else len(ids)
        found += ids[at:stop]
        stop = max(stop, at + 1)  # the other head is the same id and will be taken there
        if stop < len(ids):
            heapreplace(heads, (ids[stop], k, stop))
        else:
            heappop(heads)
    return found


def difference(ids: list[int], others: list[int]) -> list[int]:
    found: list[int] = []
    at = other = 0
    while at < len(ids):
        other = gallop(others, ids[at], other) if other < len(others) else other
        if other == len(others):
            return found + ids[at:]
        if others[other] == ids[at]:
            at += 1
        else:
            stop = gallop(ids, others[other], at)
            found += ids[at:stop]
            at = stop
    return found


def sizes(lists: list[list[int]], marks: list[list[int]]) -> dict[tuple[int, int], list[int]]:
    """By (set of filters before as bits, filter): what the filter then removes, what both cover
    together, and how many removed ids carry each mark."""
    found = {}
    for before in range(1 << len(lists)):
        covered = union([ids for f, ids in enumerate(lists) if before >> f & 1])
        for f, ids in enumerate(lists):
            if not before >> f & 1:
                gone = difference(ids, covered)
                found[before, f] = [len(gone), len(covered) + len(gone), *[len(gone) - len(difference(gone, m)) for m in marks]]
    return found


def _sizes(n_filters: int, n_marks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.string()), ("before", pa.int32()), ("filter", pa.int32()), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            totals: dict[tuple, list[int]] = defaultdict(lambda: [0] * (2 + n_marks))
            for row in range(batch.num_rows):
                part, *lists = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                for key, counts in sizes(lists[:n_filters], lists[n_filters:]).items():
                    total = totals[part, *key]
                    totals[part, *key] = [a + b for a, b in zip(total, counts)]
            yield batch_of(schema, *([k[i] for k in totals] for i in range(3)), list(totals.values()))

    return run


def posting_lists(entries: DataFrame, names: list[str]) -> DataFrame:
    """part, range and one sorted array of ids for each of `names`, from rows (part, _row, name)."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("name") == n, (F.col("_row") % RANGE).cast("int")))).alias(n) for n in names]
    return entries.groupBy("part", F.floor(F.col("_row") / RANGE).alias("range")).agg(*lists)


def audit(rows: DataFrame, entries: DataFrame, filters: str = FILTERS, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """One row per part, order of the filters and step, from all rows (part) and the failures and marks
    (part, _row, name): part, filter_order, step, kept, removed, redundant, unique_fails, `<mark>_lost`
    per mark, shapley. A row of `entries` may not repeat. Work grows with filters x 2^filters."""
    n, everything = len(filters), (1 << len(filters)) - 1
    lists = settled(posting_lists(entries, [*filters, *marks]), "posting-lists")
    counted = lists.drop("range").mapInArrow(_sizes(n, len(marks)), "part string, before int, filter int, counts array<bigint>")
    sums = [F.sum(F.col("counts")[i]).alias(c) for i, c in enumerate(("removed", "covered", *marks))]
    counted = counted.groupBy("part", "before", "filter").agg(*sums)
    # One row per part: sizes by set before and filter, of which there are filters x 2^(filters - 1).
    weight = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])[F.bit_count("before")]
    values = F.struct("removed", "covered", *marks)
    shapley = [F.sum(F.when(F.col("filter") == f, F.col("removed") * weight)) for f in range(n)]
    by_part = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("before") * n + F.col("filter"), values))).alias("_sizes"), F.array(*shapley).alias("_shapley"))
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_total"))
    steps = []
    for order in permutations(range(n)):
        name, before = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((name, step, f, before))
            before |= 1 << f
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"f":{f},"b":{b}}}' for o, s, f, b in steps) + "]"), "array<struct<o:string,s:int,f:int,b:int>>")
    spread = totals.join(by_part, "part", "left").select("*", F.explode(table).alias("_s"))

    def size(before, column):
        return F.coalesce(F.col("_sizes")[(before * n + F.col("_s.f")).cast("int")][column], F.lit(0)).cast("bigint")

    removed = size(F.col("_s.b"), "removed")
    others = F.element_at(F.array(*[F.lit(everything ^ 1 << f) for f in range(n)]), F.col("_s.f") + 1)
    return spread.select(
        "part",
        F.col("_s.o").alias("filter_order"),
        F.col("_s.s").alias("step"),
        (F.col("_total") - size(F.col("_s.b"), "covered")).alias("kept"),
        removed.alias("removed"),
        (size(F.lit(0), "removed") - removed).alias("redundant"),
        size(others, "removed").alias("unique_fails"),
        *[size(F.col("_s.b"), m).alias(f"{m}_lost") for m in marks],
        F.coalesce(F.col("_shapley")[F.col("_s.f")], F.lit(0)).cast("bigint").alias("shapley"),
    )


def text_failures(text: bytes) -> int:
    """Filters A to D as bits: few words, few distinct words, many capitals, a sign."""
    words = text.split()
    n, characters = len(words), len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * characters) << 2 | signs << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("_fails", pa.int32()), ("_digest", pa.binary())])
    for batch in pieces(batches, "text"):
        texts = [text.encode("utf-8", "surrogatepass") for text in strings(batch, "text")]
        yield batch_of(schema, batch.column(1), batch.column(2), [text_failures(t) for t in texts], [hashlib.sha256(t).digest() for t in texts])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audit` of five text filters over `docs` (doc_id, text, lang), with labels (doc_id, quality,
    toxic). A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z of the
    characters; D: one of #$%&*|; E: the text (by its SHA-256) of a smaller doc_id.

    A part is a language; null languages are the part "". Null texts are empty. A null doc_id counts as
    larger than any other and has no labels; rows that repeat doc_id and text do not fail E through each
    other, and each counts. Of several labels of a document one is enough. An empty table gives no rows.
    Other columns are ignored.
    """
    ready(docs.sparkSession)
    taken = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = taken.mapInArrow(_judge, "doc_id bigint, part string, _fails int, _digest binary").withColumn("_row", F.monotonically_increasing_id())
    rows = settled(rows, "judged")  # the row numbers with them, so that every later step has the same
    failed = F.filter(F.array(*[F.when(F.col("_fails").bitwiseAND(1 << k) != 0, F.lit(f)) for k, f in enumerate(FILTERS[:4])]), lambda x: x.isNotNull())
    alone = rows.select("part", "_row", F.explode(failed).alias("name"))
    firsts = rows.groupBy(F.col("_digest").alias("_same")).agg(F.min("doc_id").alias("_first"))
    copies = rows.join(firsts, (F.col("_digest") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_anti").select("part", "_row", F.lit("E").alias("name"))
    entries = alone.unionByName(copies)
    for name, mark in (("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)):
        marked = labels.filter(mark).select("doc_id").distinct()
        entries = entries.unionByName(rows.join(marked, "doc_id", "left_semi").select("part", "_row", F.lit(name).alias("name")))
    return audit(rows, entries)
