"""Reversible line dedup: exact reference-count tables behind sharded cuckoo filters.

The state of an index is two tables in a folder per version:

* `references`: (shard, key, doc_id, n), how often each document holds each line. It is exact, so a
  document can be taken out again and every count, and the largest document that holds a line, is
  as if it had never been there.
* `filters`: one cuckoo filter per shard of keys, holding the lines that enough documents share.
  A filter stores a 16-bit mark per line in one of two buckets; marks can be removed again, so it
  follows deletions.

Readers ask the filters first: a line that no filter holds is certainly not shared, and a document
without such lines is finished where it is read, without a shuffle. What the filters let through is
settled by the exact counts. The filters are sent to the readers only while their size, known before
they are built, is within `FILTER_BYTES`; beyond it all references go to the exact counts by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import batch_of, pieces, ready, settled, strings

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 50_000  # keys of a filter, on average
FILTER_BYTES = 32 << 20
KEY_BYTES = 16


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of the line without the blanks at its ends, A-Z in lower case; None if it is short."""
    line = line.strip(BLANKS)
    return hashlib.sha256(line.encode("utf-8", "surrogatepass").lower()).digest()[:KEY_BYTES] if len(line) >= min_chars else None


class CuckooFilter:
    """Marks of 16 bits in buckets of four, each key in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, keys: int) -> None:
        # A power of two of buckets, at most 84 % full, so that insertions find a place.
        self.buckets = 1 << max(1, (max(1, int(keys / 0.84 / self.SLOTS))).bit_length())
        self.table = np.zeros(self.buckets * self.SLOTS, dtype=np.uint16)
        self.over: list[tuple[int, int]] = []  # marks that found no place: kept, so none is lost

    @staticmethod
    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mark (never 0) and first bucket's hash of keys given as rows of two uint64."""
        return (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), keys[:, 1] >> np.uint64(24)

    def other(self, bucket, mark):
        """The second bucket of a mark; applied twice, the first."""
        return bucket ^ ((mark * 0x5BD1E995 + 1) & (self.buckets - 1))

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket * self.SLOTS : (bucket + 1) * self.SLOTS]
        free = np.flatnonzero(row == 0)
        if len(free):
            row[free[0]] = mark
        return len(free) > 0

    def insert(self, bucket: int, mark: int) -> None:
        bucket &= self.buckets - 1
        if self._put(bucket, mark) or self._put(bucket := self.other(bucket, mark), mark):
            return
        for kick in range(self.KICKS):
            slot = bucket * self.SLOTS + (kick + mark) % self.SLOTS
            mark, self.table[slot] = int(self.table[slot]), mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return
        self.over.append((bucket, mark))

    def delete(self, bucket: int, mark: int) -> bool:
        """Take one mark of a key that was inserted."""
        bucket &= self.buckets - 1
        for b in (bucket, self.other(bucket, mark)):
            row = self.table[b * self.SLOTS : (b + 1) * self.SLOTS]
            at = np.flatnonzero(row == mark)
            if len(at):
                row[at[0]] = 0
                return True
            if (b, mark) in self.over:
                self.over.remove((b, mark))
                return True
        return False

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for each key that was inserted, and for few others."""
        marks, first = self.split(keys)
        wide = marks.astype(np.int64)
        one = (first & np.uint64(self.buckets - 1)).astype(np.int64)
        two = self.other(one, wide)
        rows = self.table.reshape(self.buckets, self.SLOTS)
        found = (rows[one] == marks[:, None]).any(axis=1) | (rows[two] == marks[:, None]).any(axis=1)
        for bucket, mark in self.over:
            found |= (wide == mark) & ((one == bucket) | (two == bucket))
        return found

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        made = cls(len(keys))
        marks, first = cls.split(keys)
        for bucket, mark in zip(first.tolist(), marks.tolist()):
            made.insert(bucket, mark)
        return made

    def pack(self) -> bytes:
        extra = np.array(self.over, dtype=np.int64).reshape(-1, 2)
        return np.int64(len(extra)).tobytes() + extra.tobytes() + self.table.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        n = int(np.frombuffer(data[:8], dtype=np.int64)[0])
        made.over = [tuple(x) for x in np.frombuffer(data[8 : 8 + 16 * n], dtype=np.int64).reshape(-1, 2).tolist()]
        made.table = np.frombuffer(data[8 + 16 * n :], dtype=np.uint16).copy()
        made.buckets = len(made.table) // cls.SLOTS
        return made


def _wide(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] % np.uint64(shards)).astype(np.int64)


# ---- references ------------------------------------------------------------------------------


def _references(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])
        for batch in pieces(batches, "text"):
            keys, ids, counts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch, "text")):
                held: dict[bytes, int] = {}
                for line in text.split("\n"):
                    if key := line_key(line, min_chars):
                        held[key] = held.get(key, 0) + 1
                keys += held.keys()
                counts += held.values()
                ids += [doc_id] * len(held)
            yield batch_of(schema, keys, ids, counts)

    return run


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key, doc_id, n: the long lines of each document. Repeated rows of a doc_id add up."""
    ready(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(_references(min_chars), "key binary, doc_id bigint, n bigint")
    return found.groupBy("key", "doc_id").agg(F.sum("n").alias("n"))


def insert_documents(held: DataFrame | None, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference table with the lines of `docs` added."""
    new = references(docs, min_chars)
    both = new if held is None else held.select(*new.columns).unionByName(new).groupBy("key", "doc_id").agg(F.sum("n").alias("n"))
    return settled(both, "line-references")


def delete_documents(held: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference table as if the rows of `docs` (doc_id and text as inserted) had never been
    in it. Counts that reach 0 go."""
    gone = references(docs, min_chars).withColumn("n", -F.col("n"))
    left = held.select(*gone.columns).unionByName(gone).groupBy("key", "doc_id").agg(F.sum("n").alias("n"))
    return settled(left.filter("n > 0"), "line-references")


def shared_keys(held: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, n_docs, last_doc of the lines that `min_docs` documents hold; the largest doc_id keeps
    the line. A null doc_id counts as one document, smaller than all others."""
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return settled(counts.filter(F.col("n_docs") >= min_docs), "shared-lines")


# ---- filters ---------------------------------------------------------------------------------


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key) sorted by shard: one row per shard with its filter."""
    schema = pa.schema([("shard", pa.int64()), ("marks", pa.binary())])
    shard, keys = None, []

    def made():
        return batch_of(schema, [shard], [CuckooFilter.of(_wide(keys)).pack()])

    for batch in batches:
        for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != shard and keys:
                yield made()
                keys = []
            shard = s
            keys.append(key)
    if keys:
        yield made()


def filters(shared: DataFrame, shards: int) -> DataFrame:
    """shard, marks: the cuckoo filter of each shard's keys. Keys are digests, so shards are even."""
    tagged = shared.select("key").mapInArrow(_tag(shards), "shard bigint, key binary")
    return tagged.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, "shard bigint, marks binary")


def _tag(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("key", pa.binary())])
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_pylist()
                yield batch_of(schema, shard_of(_wide(keys), shards), keys)

    return run


def changed_filter(packed: bytes, added: list[bytes], removed: list[bytes]) -> bytes:
    """A shard's filter after lines became shared or ceased to be."""
    made = CuckooFilter.unpack(packed)
    for keys, step in ((removed, made.delete), (added, made.insert)):
        if keys:
            marks, first = CuckooFilter.split(_wide(keys))
            for bucket, mark in zip(first.tolist(), marks.tolist()):
                step(bucket, mark)
    return made.pack()


# ---- dropping --------------------------------------------------------------------------------


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _screen(packed: list[tuple[int, bytes]] | None, shards: int, min_chars: int, whole: bool):
    """Rows as read: those whose lines no filter holds are finished, the others keep their text and
    the keys to look up. With `whole` finished rows keep their text, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard = None if packed is None else {shard: CuckooFilter.unpack(data) for shard, data in packed}
        for batch in pieces(batches, "text"):
            schema = pa.schema([batch.schema.field(0), ("n_lines", pa.int64()), ("text", pa.string()), ("kept_sha256", pa.string()), ("_keys", pa.list_(pa.binary()))])
            texts = strings(batch, "text")
            lines = [text.split("\n") for text in texts]
            found = [sorted({key for line in doc if (key := line_key(line, min_chars))}) for doc in lines]
            if by_shard is not None and (every := [key for doc in found for key in doc]):
                wide = _wide(every)
                shard, hit = shard_of(wide, shards), np.zeros(len(every), dtype=bool)
                for s in np.unique(shard).tolist():
                    if s in by_shard:
                        rows = np.flatnonzero(shard == s)
                        hit[rows] = by_shard[s].holds(wide[rows])
                flags = iter(hit.tolist())
                found = [[key for key in doc if next(flags)] for doc in found]
            yield batch_of(
                schema,
                batch.column(0),
                [len(doc) for doc in lines],
                batch.column(1).cast(pa.string()) if whole else [text if keys else None for text, keys in zip(texts, found)],
                [None if keys else _sha(text) for text, keys in zip(texts, found)],
                found,
            )

    return run


def _drop(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            schema = pa.schema([batch.schema.field(0), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
            out: list[list] = [[], [], [], []]
            for n_lines, text, gone in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                gone = set(gone or ())
                kept = [line for line in text.split("\n") if not gone or line_key(line, min_chars) not in gone]
                text = "\n".join(kept)
                for column, value in zip(out, (n_lines, n_lines - len(kept), _sha(text), text)):
                    column.append(value)
            yield batch_of(schema, batch.column(0), *out)

    return run


def line_dedup(docs: DataFrame, held: DataFrame | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, keep: bool = False) -> DataFrame:
    """Drop lines that many documents share, but for the largest doc_id that holds them.

    `docs`: doc_id, text (null is one empty line). `held`: the reference table that decides, by
    default that of `docs`. One row per row of `docs`: `_doc` (a struct of the row's doc_id, or
    with `keep` of all its columns but text), n_lines, n_dropped, kept_sha256 and `text`, what stays;
    without `keep` it is null where no line was looked up. Lines are compared without blanks at their ends and with A-Z in
    lower case; only lines of `min_chars` code points or more count. Rows that repeat one doc_id are
    one document and are treated alike. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    held = insert_documents(None, docs, min_chars) if held is None else held
    shared = shared_keys(held, min_docs)
    n_shared = shared.count()
    shards = max(1, -(-n_shared // SHARD_KEYS))
    packed = None
    # A filter has at most 4 / 0.84 slots of 2 bytes a key: the size is known before one is built.
    if n_shared * 10 + shards * 64 <= filter_bytes:
        packed = [(row["shard"], bytes(row["marks"])) for row in filters(shared, shards).collect()]
    rows = docs.select(F.struct(*([c for c in docs.columns if c != "text"] if keep else ["doc_id"])).alias("_doc"), "text")
    first = rows.schema["_doc"]
    numbers = [T.StructField("n_lines", T.LongType())]
    screened = rows.mapInArrow(
        _screen(packed, shards, min_chars, keep),
        T.StructType([first, *numbers, T.StructField("text", T.StringType()), T.StructField("kept_sha256", T.StringType()), T.StructField("_keys", T.ArrayType(T.BinaryType()))]),
    )
    screened = settled(screened.withColumn("_row", F.monotonically_increasing_id()), "screened-lines")
    finished = screened.filter("kept_sha256 IS NOT NULL").select("_doc", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), "kept_sha256", "text")
    open_rows = screened.filter("kept_sha256 IS NULL")
    asked = open_rows.select("_row", F.col("_doc.doc_id").alias("_id"), F.explode("_keys").alias("key"))
    gone = asked.join(shared, "key").filter(~F.col("_id").eqNullSafe(F.col("last_doc"))).groupBy("_row").agg(F.collect_list("key").alias("_gone"))
    dropped = open_rows.join(gone, "_row", "left").select("_doc", "n_lines", "text", "_gone")
    dropped = dropped.mapInArrow(
        _drop(min_chars),
        T.StructType([first, *numbers, T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())]),
    )
    return finished.unionByName(dropped)
