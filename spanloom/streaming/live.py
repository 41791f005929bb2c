"""Structured Streaming: live segment feed, progress and stall state, history, parts chained on arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.functions.wording import canonical_path
from spanloom.operators.catalog import MAX_JOIN_GAP_S, upsert_history
from spanloom.session import settle

# ---- fixed values: the stages of a run and their share of the progress figure -------------------
STAGES = (
    ("digest", 0.02), ("decode", 0.05), ("publisher", 0.32), ("detector", 0.38), ("scenes", 0.03), ("speakers", 0.15), ("outputs", 0.05),
)
ETA_MIN_FRACTION = 0.05
STALL_S = 20
# ---------------------------------------------------------------------------------------------------
HISTORY_BUCKETS = 64


def live_segments(segments: DataFrame, role: str = "publisher") -> DataFrame:
    """The published source's segments as they come: whitespace collapsed, blanks dropped."""
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return segments.where(F.col("role") == role).withColumn("text", text).where(F.col("text") != "")


def _overall(stage: str, fraction: float, parallel: bool, seen: dict[str, float]) -> float:
    starts, at = {}, 0.0
    for name, weight in STAGES:
        starts[name] = at
        at += weight
    weights, fraction = dict(STAGES), min(1.0, max(0.0, fraction))
    if parallel and stage in ("publisher", "detector"):
        seen[stage] = fraction
        total = starts["publisher"] + sum(weights[s] * seen.get(s, 0.0) for s in ("publisher", "detector"))
    else:
        total = starts[stage] + weights[stage] * fraction
    return min(1.0, max(0.0, total))


PROGRESS = "item_id string, stage string, fraction double, elapsed_s double, eta_s double, stalled boolean"


def _progress(by_event_time: bool):
    columns = [c.split()[0] for c in PROGRESS.split(", ")]

    def report(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # A stall is only reported; what is known of the item stays for its next report.
            _, publisher, detector, stage, fraction, elapsed = state.get
            state.update(state.get)
            yield pd.DataFrame([(key[0], stage, fraction, elapsed, None, True)], columns=columns)
            return
        eta, publisher, detector, *_ = state.get if state.exists else (None, 0.0, 0.0, "", 0.0, 0.0)
        seen, out = {"publisher": publisher, "detector": detector}, []
        reports = pd.concat(list(batches)).sort_values("elapsed_s")
        for row in reports.itertuples():
            overall = _overall(row.stage, row.fraction, bool(row.parallel), seen)
            shown = None
            if overall >= ETA_MIN_FRACTION and row.elapsed_s > 0:
                raw = row.elapsed_s * (1.0 - overall) / overall
                eta = raw if eta is None else 0.7 * eta + 0.3 * raw
                shown = max(0.0, eta)
            out.append((key[0], row.stage, overall, row.elapsed_s, shown, False))
        if out[-1][2] >= 1.0:
            state.remove()  # the item is done
        else:
            state.update((eta, seen["publisher"], seen["detector"], out[-1][1], out[-1][2], out[-1][3]))
            if by_event_time:
                last = int(reports["at_ms"].max()) + STALL_S * 1000
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
            else:
                state.setTimeoutDuration(STALL_S * 1000)
        yield pd.DataFrame(out, columns=columns)

    return report


def progress(reports: DataFrame, at: str | None = None) -> DataFrame:
    """Overall progress with a smoothed estimate per report (item_id, stage, fraction, elapsed_s,
    parallel), and one `stalled` row for an item that has not reported for 20 s: by the clock, or by
    the watermark of the column `at`, which the stream must carry. By the clock a query never ends of
    itself, since time alone can bring rows."""
    columns = ["item_id", "stage", "fraction", "elapsed_s", "parallel"]
    if at is not None:
        # The time itself stays, as it carries the watermark.
        reports = reports.select(*columns, at, F.unix_millis(at).alias("at_ms"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if at is None else GroupStateTimeout.EventTimeTimeout
    state = "eta double, publisher double, detector double, stage string, fraction double, elapsed_s double"
    return reports.groupBy("item_id").applyInPandasWithState(_progress(at is not None), PROGRESS, state, "append", timeout)


def keep_history(entries: DataFrame, folder: str, checkpoint: str, buckets: int = HISTORY_BUCKETS):
    """Upsert finished items into a history table that is split by a hash of the path. A batch rewrites
    the buckets it touches, below data/v=<batch>, and then a manifest that names the newest version of
    every bucket; the manifest before it stays, older ones go with the data that only they name. A
    replayed batch starts from the same manifest, so nothing is counted twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = settle(batch.withColumn("__b", F.pmod(F.xxhash64(canonical_path("path")), F.lit(buckets)).cast("int")))
        touched = [r["__b"] for r in batch.select("__b").distinct().collect()]  # at most `buckets`
        base = _manifest(spark, folder, batch_id)
        old = _bucket_rows(spark, folder, {b: v for b, v in base.items() if b in touched})
        rows = batch.drop("__b")
        merged = upsert_history(rows.limit(0) if old is None else old, rows)
        merged = merged.withColumn("__b", F.pmod(F.xxhash64(canonical_path("path")), F.lit(buckets)).cast("int"))
        merged.repartition("__b").write.mode("overwrite").partitionBy("__b").parquet(f"{folder}/data/v={batch_id}")
        now = {**base, **dict.fromkeys(touched, batch_id)}
        spark.createDataFrame(list(now.items()) or [(-1, -1)], "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/v={batch_id}")
        _drop_unnamed(spark, folder, {*base.values(), *now.values(), batch_id}, batch_id)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _versions(spark, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in system.listStatus(path) if s.getPath().getName().startswith("v="))


def _manifest(spark, folder: str, before: int | None = None) -> dict[int, int]:
    """Version by bucket, of the newest manifest (older than `before`) that was written whole."""
    for number in reversed([n for n in _versions(spark, f"{folder}/manifests") if before is None or n < before]):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests/v={number}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.schema("bucket int, version bigint").parquet(f"{folder}/manifests/v={number}").collect()
            return {r.bucket: r.version for r in rows if r.bucket >= 0}
    return {}


def _bucket_rows(spark, folder: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{folder}/data/v={v}/__b={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def _drop_unnamed(spark, folder: str, named: set[int], newest: int) -> None:
    """Delete data that neither the newest manifest nor the one before it names, and older manifests."""
    manifests = _versions(spark, f"{folder}/manifests")
    kept = [n for n in manifests if n <= newest][-2:]
    gone = [f"{folder}/manifests/v={n}" for n in manifests if n < kept[0]]
    gone += [f"{folder}/data/v={n}" for n in _versions(spark, f"{folder}/data") if n < newest and n not in named]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def version(spark, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest history (older than batch `before`), None when there is none."""
    return _bucket_rows(spark, folder, _manifest(spark, folder, before))


def arriving_parts(files: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Files (folder, ext, name, start_utc TIMESTAMP, duration_s) chained as they arrive. A session
    window joins a file that starts within the gap after the previous one's end; it cannot express
    the limit on overlap, so the batch `group_parts` decides in the end."""
    gap = F.format_string("%d seconds", F.ceil(F.col("duration_s") + MAX_JOIN_GAP_S).cast("bigint"))
    return (
        files.withWatermark("start_utc", watermark)
        .groupBy("folder", "ext", F.session_window("start_utc", gap))
        .agg(F.count("*").alias("parts"), F.min("start_utc").alias("first_start"))
        .drop("session_window")
    )
