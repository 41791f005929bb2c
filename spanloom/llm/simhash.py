"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints of 64 bits are eight positional bytes. Two fingerprints that differ in at most four
bits differ in at most four bytes, so they share at least four (position, byte) entries: that is the
guaranteed number of matches. A posting list per single byte would hold 1/256 of all documents, so
the index is kept on each set of four positions (70 sets): its entries are the intersections of four
posting lists, and they stay short however many documents there are. Inside an entry the shared
bytes of a pair are tallied, pairs under the guaranteed number are dropped, and the bits of the rest
are compared.

Equal fingerprints are one node from the start. An entry gives a spanning forest of its links, not
all its pairs; an entry of more than `TILE` nodes is cut into tiles that meet two by two as tasks of
their own. Components come from rounds of star contraction over tables in the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import batch_of, pieces, ready, settled, strings

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
BYTES = 8
TILE = 4096
HASHES = 1 << 14  # shingles whose bits are counted at a time


def simhash(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint: a bit is set if it is set in more than half of the shingles' XXH64.
    Words are separated by ASCII white space, A-Z in lower case; a text of fewer words is one
    shingle, one without words has fingerprint 0."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    cuts = list(zip(starts[:n].tolist(), last.tolist()))
    for i in range(0, n, HASHES):
        hashes = np.array([digest(line[a:b], seed) for a, b in cuts[i : i + HASHES]], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("_print", pa.int64())])
        for batch in pieces(batches, "text"):
            yield batch_of(schema, batch.column(0), batch.column(1), [_signed(simhash(text, words, seed)) for text in strings(batch, "text")])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, _row (the row's number as read, or as stored with it), _print (the 64 bits as BIGINT) per row of `docs`."""
    ready(docs.sparkSession)
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    numbered = docs.select("doc_id", row.alias("_row"), "text")
    return numbered.mapInArrow(_fingerprints(words, seed), "doc_id bigint, _row bigint, _print bigint")


# ---- links -----------------------------------------------------------------------------------


def links_within(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `left`, or between `left` and `right`: positional bytes
    are tallied, pairs with fewer than the guaranteed number are dropped, bits decide."""
    both = left if right is None else np.concatenate([left, right])
    parent = list(range(len(both)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    other = both if right is None else right
    shift = 0 if right is None else len(left)
    found = []
    for i in range(len(left)):
        rest = other[i + 1 :] if right is None else other
        apart = rest ^ left[i]
        shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= BYTES - max_bits)
        near = near[np.bitwise_count(apart[near].view(np.uint64)) <= max_bits]  # of signed numbers it counts the absolute value
        for k in near.tolist():
            j = k + (i + 1 if right is None else shift)
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                found.append((int(both[i]), int(both[j])))
    return found


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int, least: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows sorted by the first `n_keys` integer columns: each key with the values of the column
    after them, if it has `least` rows or more. A key may go on over any number of batches."""
    key, parts = None, []

    def flushed():
        if sum(map(len, parts)) >= least:
            yield key, parts[0] if len(parts) == 1 else np.concatenate(parts)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys + 1)]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for column in columns[:n_keys]:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], batch.num_rows)
        wanted = ends - starts >= least
        wanted[[0, -1]] = True  # the first run may go on from the last batch, the last one into the next
        for k in np.flatnonzero(wanted).tolist():
            a, b = int(starts[k]), int(ends[k])
            now = tuple(int(c[a]) for c in columns[:n_keys])
            if now != key:
                yield from flushed()
                key, parts = now, []
            parts.append(columns[n_keys][a:b])
    if parts:
        yield from flushed()


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("_set", pa.int64()), ("_entry", pa.int64()), ("_size", pa.int64())])
EDGE_COLUMNS = "a bigint, b bigint, _set bigint, _entry bigint, _size bigint"


def _entries(max_bits: int, tile: int):
    """Entries of the index: links of a short one, the members of a long one as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (which, entry), values in _runs(batches, 2, 2):
            if len(values) <= tile:
                found = links_within(values, None, max_bits)
                if found:
                    a, b = zip(*found)
                    yield batch_of(EDGES, a, b, *[[None] * len(a)] * 3)
            else:
                n = len(values)
                yield batch_of(EDGES, values, [None] * n, [which] * n, [entry] * n, [n] * n)

    return run


def _tiles(max_bits: int):
    """Rows (set, entry, i, j, side, print) sorted: tiles i and j of an entry meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        pair, held = None, {}

        def met():
            left, right = held.get(0), held.get(1)
            if left is None or (right is None and pair[2] != pair[3]):
                return []
            return links_within(left, right, max_bits)

        def out(found):
            a, b = zip(*found)
            return batch_of(schema, a, b)

        for key, values in itertools.chain(_runs(batches, 5, 1), [(None, None)]):
            if key is None or key[:4] != pair:
                if pair is not None and (found := met()):
                    yield out(found)
                pair, held = key and key[:4], {}
            if key is not None:
                held[key[4]] = values

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """a, b: links between the distinct values of `_print` that connect exactly what all pairs of at
    most `max_bits` differing bits connect."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be under 8, so that a pair shares a positional byte")
    sets = list(itertools.combinations(range(BYTES), BYTES - max_bits))
    masks = [_signed(sum(0xFF << (8 * p) for p in chosen)) for chosen in sets]
    index = prints.select("_print", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("_set", "_mask"))
    index = index.select(F.col("_set").cast("bigint").alias("_set"), F.col("_print").bitwiseAND(F.col("_mask")).alias("_entry"), "_print")
    index = index.repartition("_set", "_entry").sortWithinPartitions("_set", "_entry")
    found = settled(index.mapInArrow(_entries(max_bits, tile), EDGE_COLUMNS), "links")
    edges = found.filter("b IS NOT NULL").select("a", "b")
    long = found.filter("b IS NULL").withColumn("_tiles", F.ceil(F.col("_size") / (tile // 2)).cast("int"))
    mine = F.pmod(F.xxhash64("a"), F.col("_tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    long = long.select("_set", "_entry", mine.alias("_mine"), other.alias("_other"), "a")
    long = long.select(
        "_set",
        "_entry",
        F.least("_mine", "_other").cast("bigint").alias("_i"),
        F.greatest("_mine", "_other").cast("bigint").alias("_j"),
        F.when(F.col("_mine") > F.col("_other"), 1).otherwise(0).cast("bigint").alias("_side"),
        F.col("a").alias("_print"),
    )
    keys = ["_set", "_entry", "_i", "_j"]
    tiles = long.repartition(*keys).sortWithinPartitions(*keys, "_side").mapInArrow(_tiles(max_bits), "a bigint, b bigint")
    return edges.unionByName(tiles).distinct()


# ---- components ------------------------------------------------------------------------------


def _least_neighbour(edges: DataFrame, name: str) -> DataFrame:
    """u, least of u and its neighbours; settled, so that the join back can split a hot node."""
    return settled(edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("least")), name)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for the nodes of `edges` (a, b). Alternates large
    and small stars until nothing changes; each round's table is in the shared folder."""
    now = settled(edges.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both, "large-star"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = settled(large.filter("u <> v").distinct(), "large")  # u > v
        small = large.join(_least_neighbour(large, "small-star"), "u")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        now = settled(small.filter("u <> v").distinct(), "small")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """doc_id, _row, fingerprint (16 hex digits), component_id, component_row per row of `docs`
    (doc_id, text, maybe _row). _row is the row's number as read unless the rows carry one, component_row
    that of the first row of component_id.

    Rows link when their fingerprints differ in at most `max_bits` bits; component_id is the smallest
    doc_id that can be reached. Null texts and texts without words have fingerprint 0 and link like
    others. Rows that repeat a doc_id are rows of their own; a null doc_id never gives a
    component its name unless the component has no other. An empty table gives no rows.
    """
    prints = settled(fingerprints(docs, words, seed), "fingerprints")
    nodes = settled(prints.groupBy("_print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first")), "nodes")
    joined = components(links(nodes.select("_print"), max_bits, tile))
    rooted = nodes.join(joined, nodes["_print"] == joined["node"], "left").select("_print", "_first", F.coalesce("root", "_print").alias("_root"))
    rooted = settled(rooted, "rooted")
    named = settled(rooted.groupBy("_root").agg(F.min("_first").alias("_first")), "named")
    classes = settled(rooted.drop("_first").join(named, "_root").select("_print", "_first"), "classes")
    digits = F.lower(F.lpad(F.hex("_print"), 16, "0"))
    return prints.join(classes, "_print").select("doc_id", "_row", digits.alias("fingerprint"), F.col("_first.doc_id").alias("component_id"), F.col("_first._row").alias("component_row"))
