"""Near-duplicates by the exact similarity of word shingles.

Two documents link when the sets of their shingles (runs of `WORDS` words, as 64-bit hashes) have a
Jaccard similarity of at least `SHARE`. No pair is left to chance: if two sets of n and m shingles
link, they share at least h = ceil(SHARE / (1 + SHARE) x (n + m)), and in any one order of all shingles
the first k that they share are among the first n - h + k and m - h + k of either (their prefixes). So
only documents that meet in prefixes are compared, and a fingerprint is not needed. With k at
1 + m / PART for the smaller set, a short passage in two long documents makes no candidates of them.

1. Equal sets are one node. The order is by hash, with the shingles that a sample finds common put
   last, so that prefixes hold rare ones; which shingles these are changes the cost only.
2. A first round compares each node with one other node for each of `FIRST` shared shingles of its
   prefix, and joins what links. Large groups of near copies become one component here.
3. The second round looks up the prefixes of larger sets in those of smaller ones, which are half as
   long, as a larger partner shares more. So a passage that nearly fills many documents which do not
   link stays out of the index: their own shingles come first and fill it. Pairs that share k shingles,
   are not in one component yet and have sizes that let them reach `SHARE` are compared.

Components do not change by links inside a component, so the result is that of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Tables, batch_of, pieces, ready, strings
from spanloom.llm.simhash import components

WORDS, SHARE, SEED = 5, (4, 5), 42
PART = 25
PASSES = 3  # in which the shingles of all prefixes meet
FIRST = 4  # shared shingles of a node in the first round
SAMPLE = 4_000  # documents that common shingles are sought in at least, about
SAMPLE_SHARE = 8  # and one in so many of larger tables
# How many are put last, and their least count in the sample: with a sample that grows with the table, a
# shingle that about 64 documents share is common in a table of any size, up to the bound of the list.
COMMON, COMMON_LEAST = 1 << 20, 8


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, sorted. Words are separated by ASCII white
    space, A-Z in lower case; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), dtype=np.uint64, count=len(last))
    return np.unique(hashes.view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """The shingles of a sorted set of which a set of that similarity has 1 + n / PART in its own
    prefix, n being the size of the smaller set."""
    n = len(found)
    length = n + (-n * share[0]) // share[1] + 1 + n // PART
    if len(common) and n:
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[:length]


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [shingle_set(text, words) for text in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["_gram"])

    return run


def common_shingles(docs: DataFrame, words: int, sample: int) -> np.ndarray:
    """The shingles that are frequent in a sample of `docs`: a bounded list, sorted. The sample is a share of
    the table: one of a fixed size would count as rare what more and more documents share, and those meet
    in pairs."""
    every = min(SAMPLE_SHARE, max(1, docs.count() // sample))
    rows = docs.filter(F.pmod(F.xxhash64("text", "_row"), F.lit(every)) == 0).select("text")
    counts = rows.mapInArrow(_grams(words), "_gram bigint").groupBy("_gram").count().filter(F.col("count") >= COMMON_LEAST)
    found = counts.orderBy(F.desc("count"), "_gram").limit(COMMON).select("_gram").toArrow()
    return np.sort(found.column("_gram").to_numpy()).astype(np.int64)


def _prefixes(words: int, share: tuple[int, int], common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("_node", pa.int64()), ("_n", pa.int32()), ("_prefix", pa.list_(pa.int64()))])
        for batch in pieces(batches, "text"):
            found = [shingle_set(text, words) for text in strings(batch, "text")]
            node = [int.from_bytes(hashlib.sha256(s.tobytes()).digest()[:8], "big", signed=True) for s in found]
            yield batch_of(schema, batch.column(0), batch.column(1), node, [len(s) for s in found], [prefix(s, common.value, share) for s in found])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_node", pa.int64()), ("_set", pa.binary())])
        for batch in pieces(batches, "text"):
            yield batch_of(schema, batch.column(0), [shingle_set(text, words).tobytes() for text in strings(batch, "text")])

    return run


def _similar(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.int64), np.frombuffer(y.as_buffer(), dtype=np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * share[1] >= (len(x) + len(y) - both) * share[0])
            mask = pa.array(keep, type=pa.bool_())
            yield batch_of(schema, a.filter(mask), b.filter(mask))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int], tables: Tables, name: str) -> DataFrame:
    """Those of the pairs (a, b) that link. Joined alike at any size, as the two joins of entries below."""
    left, right = sets.toDF("a", "_left"), sets.toDF("b", "_right")
    joined = tables.settle(pairs, f"{name}-pairs").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "_left", "_right")
    links = tables.settle(joined.mapInArrow(_similar(share), "a bigint, b bigint"), f"{name}-links")
    tables.drop(f"{name}-pairs")
    return links


def _least_shared(n: Column) -> Column:
    """Prefix shingles that two linked sets share, the smaller having `n`."""
    return F.floor(n / PART) + 1


def _shared_by(n: Column, m: Column, share: tuple[int, int]) -> Column:
    """Shingles that two linked sets of `n` and `m` share at least."""
    return F.ceil((n + m) * share[0] / (share[0] + share[1]))


def candidates(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: the pairs of nodes of different roots that can link, from the entries (_gram, _node, _n,
    _pos, _root) of prefixes, _pos being a shingle's place in its prefix from 0 on."""
    size = F.col("_n").cast("bigint")
    index = entries.filter(F.col("_pos") < size - _shared_by(size, size, share) + _least_shared(size))
    small, large = index.alias("s"), entries.alias("l")
    n, m = F.col("l._n").cast("bigint"), F.col("s._n").cast("bigint")
    spare = _least_shared(m) - _shared_by(n, m, share)
    first = (m < n) | ((m == n) & (F.col("s._node") < F.col("l._node")))
    reach = (m * share[1] >= n * share[0]) & (F.col("s._pos") < m + spare) & (F.col("l._pos") < n + spare)
    pairs = small.join(large, (F.col("s._gram") == F.col("l._gram")) & (F.col("s._root") != F.col("l._root")) & first & reach)
    pairs = pairs.groupBy(F.col("s._node").alias("a"), F.col("l._node").alias("b")).agg(F.count(F.lit(1)).alias("_shared"), F.first(m).alias("_n"))
    return pairs.filter(F.col("_shared") >= _least_shared(F.col("_n"))).select("a", "b")


def shingle_groups(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, first: int = FIRST, sample: int = SAMPLE) -> DataFrame:
    """_row, doc_id, component_id, component_row per row of `docs` (_row, doc_id, text), a table whose
    _row is stored with it. component_id is the smallest doc_id that can be reached over links,
    component_row the _row of its first row. `share` is the least similarity, as a fraction.

    Null texts and texts without words are equal to each other. A null doc_id never gives a component
    its name unless the component has no other. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    tables = Tables(spark)
    settle, drop = tables.settle, tables.drop
    docs = docs.select("_row", "doc_id", "text")
    # Bounded: COMMON integers.
    common = spark.sparkContext.broadcast(common_shingles(docs, words, sample))
    prefixes = docs.mapInArrow(_prefixes(words, share, common), "_row bigint, doc_id bigint, _node bigint, _n int, _prefix array<bigint>")
    prefixes = settle(prefixes, "shingle-prefixes")
    rows = settle(prefixes.select("_row", "doc_id", "_node"), "shingle-rows")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    nodes = settle(rows.groupBy("_node").agg(F.min(named).alias("_first")), "shingle-nodes")
    owners = nodes.select("_node", F.col("_first._row").alias("_row"))
    prefixes = settle(prefixes.join(owners, ["_node", "_row"], "left_semi").select("_node", "_row", "_n", "_prefix"), "node-prefixes")
    drop("shingle-prefixes")

    # Pass by pass, so that only a part of the prefixes' shingles is on its way at a time.
    every, passes = prefixes.select("_node", "_row", "_n", F.posexplode("_prefix").alias("_pos", "_gram")), []
    for i in range(PASSES):
        mine = every.filter(F.pmod(F.col("_gram"), F.lit(PASSES)) == i)
        shared = settle(mine.groupBy("_gram").count().filter("count > 1").select("_gram"), "shared-shingles")
        passes.append(settle(mine.join(shared.hint("merge"), "_gram", "left_semi"), f"shared-entries-{i}"))
        drop("shared-shingles")
    entries = reduce(DataFrame.unionByName, passes)
    drop("node-prefixes")
    # A set of n links with sets of n * share at least.
    enough = _least_shared(F.ceil(F.col("_n") * share[0] / share[1]))
    busy = entries.groupBy("_row", "_node", "_n").agg(F.count(F.lit(1)).alias("_shared")).filter(F.col("_shared") >= enough)
    busy = settle(busy.select("_row", "_node"), "busy-nodes")
    entries = entries.join(busy.select("_node"), "_node", "left_semi").select("_gram", "_node", "_n", "_pos")
    entries = settle(entries, "shingle-entries")
    drop(*[f"shared-entries-{i}" for i in range(PASSES)])
    sets = docs.select("_row", "text").join(busy, "_row").select("_node", "text").mapInArrow(_sets(words), "_node bigint, _set binary")
    sets = settle(sets, "shingle-sets")
    # By hash, so that near copies choose the same ones.
    ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64("_gram").alias("order"), F.col("_gram").alias("gram"))))
    starts = entries.groupBy("_node").agg(F.slice(ordered, 1, first).alias("_some"))
    starts = settle(starts.select("_node", F.explode("_some.gram").alias("_gram")), "shingle-starts")
    hubs = settle(starts.groupBy("_gram").agg(F.min_by("_node", F.xxhash64("_node", "_gram")).alias("_hub")), "shingle-hubs")
    stars = starts.join(hubs, "_gram").filter("_node <> _hub").select(F.least("_node", "_hub").alias("a"), F.greatest("_node", "_hub").alias("b")).distinct()
    links = _linked(stars, sets, share, tables, "first")
    drop("shingle-starts", "shingle-hubs")
    joined = settle(components(links), "first-components")

    roots = busy.select("_node").join(joined, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("root", "_node").alias("_root"))
    rooted = settle(entries.join(settle(roots, "shingle-roots"), "_node").select("_gram", "_node", "_n", "_pos", "_root"), "rooted-entries")
    drop("shingle-entries", "shingle-roots", "busy-nodes")
    mixed = rooted.groupBy("_gram").agg(F.min("_root").alias("low"), F.max("_root").alias("high")).filter("low <> high").select("_gram")
    still = settle(rooted.join(settle(mixed, "open-shingles").hint("merge"), "_gram", "left_semi"), "open-entries")
    drop("rooted-entries", "open-shingles")
    links = links.unionByName(_linked(candidates(still, share), sets, share, tables, "second"))
    drop("open-entries", "shingle-sets")

    joined = components(links)
    rooted = nodes.join(joined, F.col("_node") == F.col("node"), "left").select("_node", "_first", F.coalesce("root", "_node").alias("_root"))
    rooted = settle(rooted, "shingle-rooted")
    named = settle(rooted.groupBy("_root").agg(F.min("_first").alias("_first")), "shingle-named")
    classes = settle(rooted.drop("_first").join(named, "_root").select("_node", "_first"), "shingle-classes")
    drop("shingle-nodes", "shingle-rooted", "shingle-named", "first-links", "second-links", "first-components")
    return rows.join(classes, "_node").select("_row", "doc_id", F.col("_first.doc_id").alias("component_id"), F.col("_first._row").alias("component_row"))
