"""Documents, review sets, sessions, history, locks and file inventories, read and written.

Writers use Spark's commit protocol: a reader never sees half a table. Each returns nothing and
runs one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import BATCH_SCHEMA, HISTORY_SCHEMA, LOCK_SCHEMA, REVIEW_SCHEMA, SESSION_SCHEMA, TRANSCRIPT_SCHEMA
from spanloom.operators import cues as cu
from spanloom.operators import documents as dc
from spanloom.sources.digests import file_digests

FORMATS = ("text", "srt", "vtt", "transcript", "review", "run")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per line or file; what does not parse keeps its text in `_corrupt`."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)


def load_documents(spark: SparkSession, path: str, schema_name: str = TRANSCRIPT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): a wrong schema name or unreadable text is a reject with its reason."""
    rows = _json(spark, path, "item_id bigint, " + dc.FULL_DOCUMENT)
    good = F.coalesce(F.col("schema") == schema_name, F.lit(False)) & F.col("_corrupt").isNull()
    why = F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise(F.concat(F.lit("not a "), F.lit(schema_name), F.lit(" document")))
    return rows.where(good).drop("_corrupt"), rows.where(~good).select("item_id", "schema", why.alias("reason"), "_corrupt")


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.mode(mode).text(path)


REVIEW = (
    "item_id bigint, schema string, audio string, duration_s double, "
    "transcript array<struct<s:double,e:double,w:string>>, marks array<struct<start:double,end:double,span_start:double,span_end:double,"
    "detector_words:int,detector_text:string,reference_words:bigint,reference_speakers:array<string>>>"
)


def load_review_marks(spark: SparkSession, path: str, schema_name: str = REVIEW_SCHEMA) -> DataFrame:
    """Marks of review documents; a span left out is the play window."""
    rows = _json(spark, path, REVIEW).where(F.col("schema") == schema_name)
    each = rows.select("item_id", "duration_s", F.posexplode("marks").alias("mark", "m")).select("item_id", "duration_s", "mark", "m.*")
    return each.withColumns({"span_start": F.coalesce("span_start", "start"), "span_end": F.coalesce("span_end", "end")})


SESSION = "item_id bigint, schema string, marks array<struct<start:double,end:double,status:string,note:string,speaker:string>>"


def load_sessions(spark: SparkSession, path: str, schema_name: str = SESSION_SCHEMA) -> DataFrame:
    rows = _json(spark, path, SESSION).where(F.col("schema") == schema_name)
    return rows.select("item_id", F.posexplode("marks").alias("mark", "m")).select("item_id", "mark", "m.*")


def write_sessions(decisions: DataFrame, path: str) -> None:
    row = F.struct("mark", F.struct("start", "end", "status", "note", "speaker").alias("v"))
    docs = decisions.groupBy("item_id").agg(F.lit(SESSION_SCHEMA).alias("schema"), F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias("marks"))
    write_documents(docs, path)


ENTRY = "struct<path:string,name:string,sha256:string,duration_s:double,profile:string,marks:int,speakers:int,produced_utc:string,outputs:map<string,string>>"


def read_history(spark: SparkSession, path: str, schema_name: str = HISTORY_SCHEMA) -> DataFrame:
    """History entries in file order; a foreign or unreadable file gives none, nor do entries
    without a path."""
    rows = _json(spark, path, f"schema string, entries array<{ENTRY}>").where(F.col("schema") == schema_name)
    each = rows.select(F.posexplode("entries").alias("place", "e")).select("place", "e.*")
    return each.where(F.coalesce("path", F.lit("")) != "").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.element_at(F.split("path", "/"), -1)))


def read_lock(spark: SparkSession, path: str, schema_name: str = LOCK_SCHEMA) -> DataFrame:
    """(key, file, sha256, bytes) of a lock keyed "<key>/<file>"; another schema gives none."""
    schema = "schema string, files map<string,struct<sha256:string,bytes:bigint,url:string>>"
    rows = _json(spark, path, schema).where(F.col("schema") == schema_name)
    each = rows.select(F.explode("files").alias("name", "entry"))
    return each.select(F.regexp_extract("name", r"^([^/]*)/", 1).alias("key"), F.regexp_replace("name", r"^[^/]*/", "").alias("file"), "entry.*")


def write_lock(lock: DataFrame, path: str) -> None:
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat("key", F.lit("/"), "file"), F.struct("sha256", "bytes"))))
    write_documents(lock.groupBy("key").agg(F.lit(LOCK_SCHEMA).alias("schema"), pairs.alias("files")), path)


def inventory(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(path, folder, name, bytes, modified[, sha256]) of the files under a folder; contents are
    read only for digests, large ones block by block. Files without bytes are not listed."""
    if digests:
        files = file_digests(spark, path)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        files = found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"),
        *files.columns[1:],
    )


def recorded_source(spark: SparkSession, path: str) -> DataFrame:
    """(base, recorded): the input each run record names."""
    rows = spark.read.schema("input_path string").option("multiLine", True).json(path)
    base = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.run\.json$", "")
    return rows.where(F.coalesce("input_path", F.lit("")) != "").select(base.alias("base"), F.col("input_path").alias("recorded"))


def write_rows(rows: DataFrame, path: str, order: Iterable[str | Column], mode: str = "overwrite") -> None:
    """Ordered text rows, one folder per item. Rows are range-partitioned by item and order, so a
    long item is several files that read in order, not one task."""
    order = list(order)
    placed = rows.repartitionByRange("item_id", *order).sortWithinPartitions("item_id", *order)
    placed.select("item_id", "value").write.mode(mode).partitionBy("item_id").text(path)


def rendered(docs: DataFrame, kind: str) -> tuple[DataFrame, list[str]]:
    if kind == "text":
        return dc.text_rows(docs), ["section", "at"]
    if kind == "transcript":
        return docs.select("item_id", F.lit(0).alias("at"), F.to_json(F.struct(*docs.columns)).alias("value")), ["at"]
    cues = cu.build_cues(dc.lines_of(docs), dc.scenes_of(docs), dc.speaker_names(docs))
    return (cu.srt_blocks(cues) if kind == "srt" else cu.vtt_blocks(cues)), ["at"]


def export_outputs(docs: DataFrame, destination: str, stem: str, formats: Iterable[str], copies: dict[str, DataFrame] | None = None, write: Callable[..., None] = write_rows) -> DataFrame:
    """Write the chosen formats to destination/stem.<format>; review and run are copied from the
    given tables and skipped without one. One failing writer does not stop the others: the result
    says per format whether it was written, and why not. `write` places the rows of a format:
    `write_rows`, or `item_files.write_items` for a file per item that replaces the last whole."""
    wanted = list(dict.fromkeys(formats))
    unknown = sorted(set(wanted) - set(FORMATS))
    if unknown:
        raise KeyError(f"unknown export format(s): {', '.join(unknown)}")
    if not stem.strip():
        raise ValueError("the file name stem must not be empty")
    copies, report = copies or {}, []
    for kind in FORMATS:
        if kind not in wanted:
            continue
        target = f"{destination}/{stem}.{kind}"
        try:
            if kind in ("review", "run"):
                if kind not in copies:
                    continue
                write_documents(copies[kind], target)
            else:
                rows, order = rendered(docs, kind)
                write(rows, target, order)
            report.append((kind, target, True, None))
        except Exception as exc:  # noqa: BLE001 - reported per format
            report.append((kind, target, False, f"{type(exc).__name__}: {exc}"))
    return docs.sparkSession.createDataFrame(report, "format string, path string, written boolean, error string")


def append_missing(rows: DataFrame, path: str, keys: Iterable[str]) -> None:
    """Append rows whose key is not stored yet: reruns resume where a run ended. Of new rows that
    share a key, the least by their columns in order is stored (`rows` has no map columns)."""
    keys, spark = list(keys), rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except Exception as exc:  # noqa: BLE001 - only a path that is not there yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        done = None
    new = rows if done is None else rows.join(done, keys, "left_anti")
    new = new.groupBy(*keys).agg(F.min(F.struct(*rows.columns)).alias("__row")).select("__row.*")
    new.write.mode("append").parquet(path)


BATCH_FACTS = "struct<schema:string,version:string,started_utc:string,ended_utc:string,profile:string,models_root:string,speakers:int,threshold:double,plan:map<string,string>>"


def write_batch(outcomes: DataFrame, path: str, batch: str, facts: Mapping[str, object]) -> None:
    """The record of a batch as rows under path/batch=<batch>: one per source of `outcomes` (path,
    status, error_class, error), and one without a path that carries `facts` (fields of BATCH_FACTS),
    so that a batch of no sources has a record too. Written again, it replaces itself."""
    spark = outcomes.sparkSession
    head = spark.createDataFrame([(json.dumps({"schema": BATCH_SCHEMA} | dict(facts)),)], "facts string")
    rows = outcomes.select("path", "status", "error_class", "error").unionByName(head.select(F.from_json("facts", BATCH_FACTS).alias("facts")), allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path}/batch={quote(batch, safe='')}")


def read_batches(spark: SparkSession, path: str, schema_name: str = BATCH_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(batches, rows): a row per batch with its facts and the number of its sources by outcome, and a
    row per source (batch, path, status, error_class, error); the failures are `catalog.failed(rows)`.
    Batches of another schema give neither."""
    schema = f"path string, status string, error_class string, error string, facts {BATCH_FACTS}, batch string"
    stored = spark.read.schema(schema).parquet(path)
    counts = {f"n_{s}": F.count_if(F.col("status") == s) for s in ("ok", "failed", "cancelled")}
    found = stored.groupBy("batch").agg(F.max(F.when(F.col("facts").isNotNull(), F.to_json("facts"))).alias("facts"), *[c.alias(n) for n, c in counts.items()])
    found = found.withColumn("facts", F.from_json("facts", BATCH_FACTS)).where(F.col("facts.schema") == schema_name)
    rows = stored.where("path IS NOT NULL").drop("facts").join(found.select("batch"), "batch", "left_semi")
    return found.select("batch", "facts.*", *counts), rows.select("batch", "path", "status", "error_class", "error")
