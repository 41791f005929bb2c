"""Timed-record tables derived from the driver's parquet tables, in Spark and as SQL text.

Times are whole milliseconds inside the derivations and seconds (milliseconds / 1000) in the
columns the operators read. The SQL in `CTE` states the same rules for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.scans import Scan, bucketed_scan
from spanloom.session import settle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ms: Column | str) -> Column:
    column = F.col(ms) if isinstance(ms, str) else ms
    return column.cast("double") / F.lit(1000.0)


def millis(s: Column | str) -> Column:
    column = F.col(s) if isinstance(s, str) else s
    return F.round(column * 1000.0).cast("bigint")


_SEGS: dict[tuple[str, str], DataFrame] = {}


def seg(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with their place in time, derived once per application and written to the
    checkpoint folder; spread over the cores because the tables below explode it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SEGS:
        _SEGS[key] = settle(_seg(spark, folder).repartition(spark.sparkContext.defaultParallelism, "item_id", "turn"))
    return _SEGS[key]


def _seg(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("item_id"), "turn", F.col("role").alias("speaker"), "text",
        F.split(F.trim("text"), r"\s+").alias("tokens"),
    )
    rows = rows.withColumn("dur", F.size("tokens").cast("bigint") * 400)
    placed = bucketed_scan(
        rows, ["item_id"], F.floor(F.col("turn") / 256), ["turn"], [Scan("start_ms", "sum_before", F.col("dur") + 1000)]
    )
    return placed.withColumn("end_ms", F.col("start_ms") + F.col("dur"))


def ref_segments(spark: SparkSession, folder: str) -> DataFrame:
    return seg(spark, folder).select(
        "item_id", F.col("turn").alias("seg"), seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), "speaker", "text"
    )


def _words_ms(spark: SparkSession, folder: str) -> DataFrame:
    exploded = seg(spark, folder).select("item_id", "turn", "speaker", "start_ms", F.posexplode("tokens").alias("pos", "word"))
    s = F.col("start_ms") + F.col("pos").cast("bigint") * 400
    return exploded.withColumn("s", s).withColumn("e", s + 400)


def _as_words(df: DataFrame, source: str, text: Column, shift: int = 0) -> DataFrame:
    return df.select(
        "item_id", F.lit(source).alias("source"), (F.col("turn") * 1000000 + F.col("pos")).alias("seq"), "turn", "pos",
        text.alias("text"), seconds(F.col("s") + shift).alias("start"), seconds(F.col("e") + shift).alias("end"), "speaker",
    )


def ref_words(spark: SparkSession, folder: str) -> DataFrame:
    return _as_words(_words_ms(spark, folder), "reference", F.col("word"))


def published(spark: SparkSession, folder: str) -> DataFrame:
    kept = _words_ms(spark, folder).where(
        (F.col("item_id") * 31 + F.col("turn") * 17 + F.floor(F.col("pos") / 5)) % 7 != 0
    )
    changed = (F.col("item_id") + F.col("turn") * 3 + F.col("pos")) % 29 == 0
    return _as_words(kept, "publisher", F.when(changed, F.concat("word", F.lit("x"))).otherwise(F.col("word")))


def detector(spark: SparkSession, folder: str) -> DataFrame:
    kept = _words_ms(spark, folder).where((F.col("item_id") + F.col("turn") + F.col("pos")) % 11 != 0)
    return _as_words(kept, "detector", F.col("word"), shift=100)


def items(spark: SparkSession, folder: str) -> DataFrame:
    return seg(spark, folder).groupBy("item_id").agg(seconds(F.max("end_ms") + 1000).alias("audio_s"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    kept = seg(spark, folder).where((F.col("item_id") * 3 + F.col("turn")) % 13 != 0)
    label = F.when((F.col("item_id") + F.col("turn")) % 9 == 0, F.lit("spk_x")).otherwise(F.concat(F.lit("spk_"), F.col("speaker")))
    return kept.select(
        "item_id", F.col("turn").alias("seq"), seconds(F.col("start_ms") + 150).alias("start"),
        seconds(F.col("end_ms") - 50).alias("end"), label.alias("label"),
    )


def event_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions per user: [t, t + value) in seconds from the epoch of the first day, one class each."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start_ms = (us - F.lit(1704067200000000)) / 1000
    names = F.create_map(*[F.lit(x) for pair in EVENT_CLASSES.items() for x in pair])
    return table(spark, folder, "events").select(
        F.col("user_id").alias("item_id"), "event_id", "event_type",
        F.floor(start_ms).cast("bigint").alias("s_ms"),
        (F.floor(start_ms) + F.round(F.col("value") * 1000)).cast("bigint").alias("e_ms"),
        names[F.col("event_type")].alias("name"),
        ((F.col("event_id") % 100) / 100.0).cast("double").alias("prob"), "value",
    ).withColumns({"start": seconds("s_ms"), "end": seconds("e_ms")})


# Sound classes the event types stand for.
EVENT_CLASSES = {"view": "Speech", "click": "Music", "purchase": "Hum", "signup": "Siren", "error": "Silence"}


CTE = r"""
toks AS (
  SELECT conv_id AS item_id, turn, role AS speaker, text,
         string_split_regex(trim(text), '\s+') AS tokens,
         len(string_split_regex(trim(text), '\s+')) * 400 AS dur
  FROM conversations),
seg AS (
  SELECT *, CAST(coalesce(sum(dur + 1000) OVER (PARTITION BY item_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM toks),
words0 AS (
  SELECT item_id, turn, speaker, start_ms, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos FROM seg),
ref_words AS (
  SELECT item_id, turn, pos, turn * 1000000 + pos AS seq, speaker, word AS text,
         start_ms + 400 * pos AS s, start_ms + 400 * pos + 400 AS e FROM words0),
published AS (
  SELECT item_id, turn, pos, seq, speaker, s, e,
         CASE WHEN (item_id + turn * 3 + pos) % 29 = 0 THEN text || 'x' ELSE text END AS text
  FROM ref_words WHERE (item_id * 31 + turn * 17 + pos // 5) % 7 <> 0),
detector AS (
  SELECT item_id, turn, pos, seq, speaker, s + 100 AS s, e + 100 AS e, text
  FROM ref_words WHERE (item_id + turn + pos) % 11 <> 0),
items AS (SELECT item_id, max(start_ms + dur) + 1000 AS audio_ms FROM seg GROUP BY item_id),
turns AS (
  SELECT item_id, turn, start_ms + 150 AS s, start_ms + dur - 50 AS e,
         CASE WHEN (item_id + turn) % 9 = 0 THEN 'spk_x' ELSE 'spk_' || speaker END AS label
  FROM seg WHERE (item_id * 3 + turn) % 13 <> 0),
regions AS (
  SELECT user_id AS item_id, event_id, event_type, value,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 1000.0) AS BIGINT) AS s,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 1000.0) AS BIGINT) + CAST(round(value * 1000) AS BIGINT) AS e,
         CASE event_type WHEN 'view' THEN 'Speech' WHEN 'click' THEN 'Music' WHEN 'purchase' THEN 'Hum'
              WHEN 'signup' THEN 'Siren' ELSE 'Silence' END AS name,
         (event_id % 100) / 100.0 AS prob
  FROM events)"""


def with_cte(body: str, more: str = "") -> str:
    """The query `body` over the derived tables, with further common tables `more`."""
    glue = "" if body.startswith(",") else "\n"
    return f"WITH RECURSIVE {CTE}{',' + more if more else ''}{glue}{body}"
