"""Streams over the driver's tables, drained and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import fixtures as fx
from spanloom.fixtures import millis, table, with_cte
from spanloom.queries import Registry
from spanloom.queries.review_queries import MARKS
from spanloom.session import scratch
from spanloom.streaming import live as lv
from spanloom.streaming import marks as mk

R = Registry()


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    # The source wants a folder or a pattern; the pattern names the one file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def drained(writer) -> None:
    """Runs until all that is there has been read; a failed query raises."""
    writer.trigger(availableNow=True).start().awaitTermination()


@R.add(
    "ST1_live_segments",
    r"SELECT conv_id AS item_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE role = 'assistant' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''",
)
def st1(spark, d):
    out = scratch(spark, "segments")
    feed = stream(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), "turn", "role", "text")
    rows = lv.live_segments(feed, "assistant").drop("role")
    drained(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c"))
    return spark.read.parquet(out)


@R.add(
    "ST4_history_upsert",
    """SELECT 'u' || user_id || '/' || event_type AS path, (max(ts)::VARCHAR)[:19] AS produced_utc FROM events GROUP BY 1""",
)
def st4(spark, d):
    out = scratch(spark, "history")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/./"), "event_type")
    entries = stream(spark, d, "events").select(path.alias("path"), F.col("ts").cast("string").alias("produced_utc"), "event_id")
    drained(lv.keep_history(entries, out, out + "-c"))
    return lv.version(spark, out).select(F.replace("path", F.lit("/./"), F.lit("/")).alias("path"), F.substring("produced_utc", 1, 19).alias("produced_utc"))


@R.add(
    "ST5_incremental_marks",
    with_cte("SELECT item_id, span_s, span_e, detector_words, detector_text FROM marks", MARKS),
)
def st5(spark, d):
    """All words and the closing of every recording as one feed; the marks of the batch review."""
    folder = scratch(spark, "marks")
    words = fx.published(spark, d).unionByName(fx.detector(spark, d)).select(
        F.lit("word").alias("kind"), "item_id", "source", "seq", "text", "start", "end", F.lit(None).cast("double").alias("audio_s")
    )
    closing = fx.items(spark, d).select(F.lit("close").alias("kind"), "item_id", "audio_s")
    feed = words.unionByName(closing, allowMissingColumns=True)
    feed.write.parquet(folder + "/feed")
    source = spark.readStream.schema(feed.schema).parquet(folder + "/feed")
    drained(mk.incremental_marks(source, folder + "/out", folder + "/c"))
    marks = mk.written(spark, folder + "/out", "mark")
    return marks.select("item_id", millis("span_start").alias("span_s"), millis("span_end").alias("span_e"), "detector_words", "detector_text")


# Reports of a run: each turn of a conversation is one, in a stage and at a fraction by its number.
def stage_of(turn):
    return F.element_at(F.array(*[F.lit(name) for name, _ in lv.STAGES]), (turn % len(lv.STAGES)).cast("int") + 1)


@R.add(
    "ST2_progress",
    """
    WITH r AS (SELECT conv_id AS item_id, turn, (turn % 10) / 10.0::DOUBLE AS fraction, CAST(turn + 1 AS DOUBLE) AS elapsed_s,
        ([0.0, 0.02, 0.07, 0.39, 0.77, 0.8, 0.95]::DOUBLE[])[turn % 7 + 1] AS s, ([0.02, 0.05, 0.32, 0.38, 0.03, 0.15, 0.05]::DOUBLE[])[turn % 7 + 1] AS w FROM conversations),
    o AS (SELECT *, s + w * fraction AS overall FROM r),
    e AS (SELECT *, CASE WHEN overall >= 0.05 THEN elapsed_s * (1.0 - overall) / overall END AS raw FROM o),
    l AS (SELECT *, list(raw) FILTER (WHERE raw IS NOT NULL) OVER (PARTITION BY item_id ORDER BY turn) AS raws FROM e)
    SELECT item_id, turn, round(overall, 9) AS overall, round(CASE WHEN raw IS NOT NULL THEN list_reduce(raws, lambda a, x: 0.7 * a + 0.3 * x) END, 6) AS eta_s FROM l""",
)
def st2(spark, d):
    """Every report of every item, with the estimate that the earlier ones lead to."""
    out = scratch(spark, "progress")
    turns = stream(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("item_id"), "turn")
    reports = turns.select("item_id", stage_of(F.col("turn")).alias("stage"), (F.col("turn") % 10 / 10.0).alias("fraction"), (F.col("turn") + 1).cast("double").alias("elapsed_s"), F.lit(False).alias("parallel"), F.timestamp_seconds(F.col("turn") + 1).alias("at"))
    drained(lv.progress(reports.withWatermark("at", "0 seconds"), "at").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-c"))
    rows = spark.read.schema(lv.PROGRESS).parquet(out).where(~F.col("stalled"))
    return rows.select(F.col("item_id").cast("bigint").alias("item_id"), (F.col("elapsed_s") - 1).cast("bigint").alias("turn"), F.round("fraction", 9).alias("overall"), F.round("eta_s", 6).alias("eta_s"))
