"""Counts that a transcript carries about itself, and flags read from its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as tx

# ---- fixed values ---------------------------------------------------------------------------
WORD_TIMING_TOKEN, WORD_TIMING_SEGMENT = "token", "segment"
SOURCES = ("publisher", "detector")
# ----------------------------------------------------------------------------------------------


def approximate_word_times(facts: Column | str) -> Column:
    """Whether an engine's facts (JSON text) say that words were placed by segment; no facts, or
    facts that say nothing of it, mean they were not."""
    facts = F.col(facts) if isinstance(facts, str) else facts
    return F.coalesce(F.get_json_object(facts, "$.word_timing"), F.lit(WORD_TIMING_TOKEN)) == WORD_TIMING_SEGMENT


def transcript_counters(segments: DataFrame) -> DataFrame:
    """Per item of `segments` (item_id, start, end, text): segments, words, segments without
    words, seconds of speech."""
    words = F.size(tx.tokenize_raw(F.coalesce("text", F.lit(""))))
    rows = segments.select("item_id", words.alias("n"), (F.col("end") - F.col("start")).alias("s"))
    return rows.groupBy("item_id").agg(
        F.count("*").alias("segments"), F.sum("n").alias("words"), F.count_if(F.col("n") == 0).alias("empty_segments"), F.sum("s").alias("speech_s")
    )


def non_speech_totals(items: DataFrame, scenes: DataFrame, suppressed: DataFrame, tagged: DataFrame) -> DataFrame:
    """Per item of `items`: seconds_by_kind of `scenes` (item_id, kind, start, end), the words of
    each source in `suppressed` (item_id, source), and whether `tagged` (item_id) has the item."""
    kinds = scenes.groupBy("item_id", "kind").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    kinds = kinds.groupBy("item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "seconds")))).alias("seconds_by_kind"))
    words = suppressed.groupBy("item_id").agg(*[F.count_if(F.col("source") == s).alias(f"suppressed_{s}_words") for s in SOURCES])
    flags = tagged.select("item_id").distinct().withColumn("tagged", F.lit(True))
    out = items.select("item_id").join(kinds, "item_id", "left").join(words, "item_id", "left").join(flags, "item_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return out.select(
        "item_id",
        F.coalesce("seconds_by_kind", none).alias("seconds_by_kind"),
        *[F.coalesce(f"suppressed_{s}_words", F.lit(0)).alias(f"suppressed_{s}_words") for s in SOURCES],
        F.coalesce("tagged", F.lit(False)).alias("tagged"),
    )


def batch_rows(outcomes: DataFrame, batch: str, profile: str) -> DataFrame:
    """A batch's record as rows (batch, profile, path, status, error_class, error), one per source,
    to be appended to the table of all batches; failures are its rows of status failed."""
    return outcomes.select(F.lit(batch).alias("batch"), F.lit(profile).alias("profile"), "path", "status", "error_class", "error")
