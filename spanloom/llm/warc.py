"""WARC archives, written with an index and read back by it.

An archive holds one WARC record per row, each a gzip member of its own. A response record holds the
payload behind an HTTP header; of rows with equal payloads the one with the smallest key is a response
and the others are revisit records, which hold the HTTP header only and name the response.

The index is written first and read first: file, offset, length, key, URL and payload digest of every
record. A reader selects rows of the index, sorts them by file and offset, puts neighbours together to
byte ranges, and reads each range at once.

At scale: payloads are shuffled once, by digest; the hottest digests are spread by a salt. Equal
payloads are found by a minimum combined before the shuffle. A task writes files of its own under
fresh names, and the index is written with Spark's commit: files of lost attempts are in no index.
Archives lie under a folder that pyarrow can open by its URI (file, s3, gs, hdfs), on every node.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import HOT, batch_of, pieces, ready, settled

FILE_BYTES = 512 << 20
READ_BYTES = 8 << 20  # a byte range starts within a block of this size
GAP = 64 << 10  # bytes that are read for nothing rather than asking again
LEAST_BYTES = 100  # shorter payloads are always stored
SALTS, HOT_COUNT = 64, 64
LEVEL = 6
NAME, NO_NAME = "urn:x-row:", "urn:x-no-row"
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_key", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])
RECORD = pa.schema([("record_key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in schema)


def _name(key: str | None) -> str:
    return NO_NAME if key is None else NAME + quote(key, safe="")


def _key(name: str) -> str | None:
    return None if name == NO_NAME else unquote(name.removeprefix(NAME))


def record_bytes(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, is_revisit: bool, date: str) -> bytes:
    """A WARC 1.1 record. Control characters and spaces of the URL are percent-encoded; the index has
    the URL as it was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{_name(key)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> tuple:
    """The fields of RECORD. A payload that does not match its digest or length is an error."""
    head, rest = data.split(b"\r\n\r\n", 1)
    warc = _headers(head)
    block = rest[: int(warc["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size, digest = int(_headers(http)["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = warc["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {warc['WARC-Record-ID']} does not match its digest")
    other = warc.get("WARC-Refers-To")
    refers_to = None if other is None else _key(other[1:-1])
    return _key(warc["WARC-Record-ID"][1:-1]), warc.get("WARC-Target-URI"), kind, refers_to, size, digest, payload.decode() if kind == "response" else None


class _Archive:
    """A file of records, opened at its first one."""

    def __init__(self, folder: str) -> None:
        self.system, base = fs.FileSystem.from_uri(folder)
        self.name = f"records-{uuid.uuid4().hex}.warc.gz"
        self.system.create_dir(base, recursive=True)
        self.stream, self.size = self.system.open_output_stream(f"{base}/{self.name}", compression=None), 0

    def add(self, record: bytes) -> tuple[int, int]:
        data = gzip.compress(record, LEVEL, mtime=0)
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in pieces(batches, "_payload"):
            rows = []
            for row in batch.to_pylist():
                if archive is None or archive.size >= file_bytes:
                    if archive is not None:
                        archive.stream.close()
                    archive = _Archive(folder)
                revisit = row["_revisit"]
                data = record_bytes(row["_key"], row["_url"], row["_payload"].encode(), row["_digest"], row["_first"], revisit, date)
                rows.append((archive.name, *archive.add(data), row["_key"], row["_url"], row["_digest"], "revisit" if revisit else "response"))
            yield batch_of(INDEX, *zip(*rows))
        if archive is not None:
            archive.stream.close()

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row below `folder`/archives and the index to `folder`/index; returns the index.

    Null payloads are empty. Of rows with equal payloads of `least` bytes or more, that with the smallest
    key is a response, the others are revisits; rows that repeat the smallest key are all responses, and
    a null key counts as larger than any other. A null URL gives no target. An empty table gives an empty
    index. Other columns are ignored.
    """
    ready(pages.sparkSession)
    rows = pages.select(pages[key].alias("_id"), pages[url].cast("string").alias("_url"), F.coalesce(pages[payload], F.lit("")).alias("_payload"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    long = F.octet_length("_payload") >= least
    groups = rows.filter(long).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = settled(groups, "equal-payloads")
    # At most HOT digests; any digest with more than 1/HOT of the rows is among them.
    hot = [r["_digest"] for r in groups.filter(F.col("_n") >= HOT_COUNT).orderBy(F.desc("_n"), "_digest").limit(HOT).collect()]
    is_hot = F.col("_digest").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    sides = groups.select("_digest", "_first", salts.alias("_salt")).select(F.col("_digest").alias("_meet"), F.col("_salt").alias("_share"), "_first")
    # Short payloads meet no group; their own names spread them.
    meets = F.when(long, F.col("_digest")).otherwise(F.xxhash64("_id", "_url").cast("string"))
    rows = rows.withColumns({"_meet": meets, "_share": salt}).join(sides.hint("merge"), ["_meet", "_share"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    rows = rows.select(F.col("_id").cast("string").alias("_key"), "_url", "_payload", "_digest", F.col("_first").cast("string").alias("_first"), revisit.alias("_revisit"))
    rows.mapInArrow(_write(f"{folder}/archives", date, file_bytes), _ddl(INDEX)).write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index below `folder`: file, offset, length, record_key, url, payload_digest, record_type."""
    return spark.read.schema(_ddl(INDEX)).parquet(f"{folder}/index")


def byte_ranges(selected: DataFrame, gap: int = GAP, block: int = READ_BYTES) -> DataFrame:
    """file, start, size and records (their places in the range) per read: records of the selected
    rows of an index that lie at most `gap` bytes apart and begin in one `block` are read together."""
    rows = selected.select("file", "offset", (F.col("offset") + F.col("length")).alias("end"), F.floor(F.col("offset") / block).alias("block")).distinct()
    before = Window.partitionBy("file", "block").orderBy("offset")
    rows = rows.withColumn("apart", (F.col("offset") - F.lag("end").over(before) > gap).cast("int"))
    rows = rows.withColumn("range", F.sum(F.coalesce("apart", F.lit(0))).over(before))
    ranges = rows.groupBy("file", "block", "range").agg(F.min("offset").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("offset", "end"))).alias("places"))
    records = F.transform("places", lambda p: F.struct((p.offset - F.col("start")).alias("begin"), (p.end - F.col("start")).alias("end")))
    return ranges.select("file", "start", (F.col("end") - F.col("start")).alias("size"), records.alias("records"))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as file:
                    data = file.read_at(row["size"], row["start"])
                found, size = [], 0
                for place in row["records"]:
                    fields = parse_record(gzip.decompress(data[place["begin"] : place["end"]]))
                    found.append(fields)
                    size += fields[4]
                    if size > READ_BYTES:
                        yield batch_of(RECORD, *zip(*found))
                        found, size = [], 0
                if found:
                    yield batch_of(RECORD, *zip(*found))

    return run


def read_records(selected: DataFrame, folder: str, gap: int = GAP, block: int = READ_BYTES) -> DataFrame:
    """The records of the selected rows of the index of `folder`: record_key, url, record_type,
    refers_to (the key of the response of a revisit), payload_bytes and payload_digest (of the full
    payload), payload (null for revisits). A payload that does not match its digest fails the read."""
    spark = ready(selected.sparkSession)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranges = byte_ranges(selected, gap, block).repartition(count, "file", "start")
    return ranges.mapInArrow(_read(f"{folder}/archives"), _ddl(RECORD))
