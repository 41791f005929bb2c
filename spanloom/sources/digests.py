"""SHA-256 of files of any size, and of recordings that are chains of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import spread
from spanloom.sources.stores import located

BLOCK_BYTES = 1 << 20
# Above this a file is not read as one value.
WHOLE_BYTES = 64 << 20


def stream_digest(path: str) -> str:
    system, name = located(path)
    digest = hashlib.sha256()
    with system.open_input_stream(name, compression=None, buffer_size=0) as stream:
        while block := stream.read(BLOCK_BYTES):
            digest.update(block)
    return digest.hexdigest()


def _stream_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [stream_digest(path)]})


def file_digests(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, bytes, modified, sha256) of every file under `path`. Files of up to `whole_bytes` are
    hashed in the JVM as Spark reads them; the reader skips the contents of larger ones, which tasks
    of their own stream block by block, in constant memory, so these need a store that pyarrow opens
    on every node. Spark's reader gives no row for a file without bytes, and none for a folder without
    files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    facts = ("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    small = files.where(F.col("length") <= whole_bytes).select(*facts, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select(*facts)
    streamed = spread(large.select("path"), "path").mapInArrow(_stream_digests, "path string, sha256 string")
    return small.unionByName(large.join(streamed, "path"))


def _chain_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, total = None, None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"at": [key], "sha256": [digest.hexdigest()], "bytes": pa.array([total], pa.int64())})

    for batch in batches:
        for at, sha256, size in zip(*(batch.column(c).to_pylist() for c in ("at", "sha256", "bytes"))):
            if at != key:
                if digest is not None:
                    yield closed()
                key, digest, total = at, hashlib.sha256(), None
            digest.update((sha256 or "").encode())
            total = total if size is None else (total or 0) + size
    if digest is not None:
        yield closed()


def chain_digests(parts: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """(*keys, sha256, bytes): per key the digest of its parts' hex digests written one behind the
    other in order, and their bytes. A key's parts are streamed past one digest in sorted order, 64
    characters each, and never gathered. Parts without a digest add nothing to it, null keys are keys."""
    keys, order = list(keys), list(order)
    # to_json leaves null fields out, so every set of keys has a text of its own.
    at = F.to_json(F.struct(*keys))
    rows = parts.select(at.alias("at"), F.col("bytes").cast("bigint").alias("bytes"), "sha256", F.struct(*order).alias("order"))
    placed = rows.repartition("at").sortWithinPartitions("at", "order", "sha256").select("at", "sha256", "bytes")
    folded = placed.mapInArrow(_chain_digests, "at string, sha256 string, bytes bigint")
    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in keys)
    return folded.select(F.from_json("at", schema).alias("k"), "sha256", "bytes").select("k.*", "sha256", "bytes")
