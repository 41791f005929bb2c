"""Reference annotations and engine output as flat tables.

Readers take a path for `spark.read` and give rows; the shaping functions take DataFrames, so any
other source of the same columns works too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.intervals import point_join

# ---- fixed values -----------------------------------------------------------------------------
CALL_ROLES = ("agent", "caller")
READER = "reader"
# -------------------------------------------------------------------------------------------------

WORD_ROW = "struct<text:string,start:double,end:double,prob:double>"
TURN_ROW = "struct<start:double,end:double,label:string>"
ENGINE_RECORD = (
    f"item_id string, variant string, kind string, words array<{WORD_ROW}>, turns array<{TURN_ROW}>, "
    "timing struct<audio_s:double,load_s:double,transcribe_s:double>, verdict struct<busy:boolean,other_load_cores:double>, versions map<string,string>"
)
CALL_SEGMENT = "index int, offset_ms bigint, start_ms bigint, duration_ms bigint, speaker_role string, human_transcript string"


def read_engine_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per (item, variant)."""
    return spark.read.schema(ENGINE_RECORD).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def engine_words(records: DataFrame) -> DataFrame:
    each = records.where(F.col("kind") == "transcript").select("item_id", "variant", F.posexplode("words").alias("seq", "w"))
    return each.select("item_id", "variant", F.col("seq").cast("bigint").alias("seq"), "w.*")


def engine_turns(records: DataFrame) -> DataFrame:
    each = records.where(F.col("kind") == "diarization").select("item_id", "variant", F.posexplode("turns").alias("seq", "t"))
    return each.select("item_id", "variant", "seq", "t.*")


def engine_runs(records: DataFrame) -> DataFrame:
    return records.select("item_id", "variant", "timing.*", "verdict.*", "versions")


def spread_words(segments: DataFrame) -> DataFrame:
    """Words of each segment (item_id, seg, start, end, speaker, text) at equal steps in its span."""
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    sized = segments.withColumn("tokens", tokens).withColumn("step", (F.col("end") - F.col("start")) / F.nullif(F.size("tokens"), F.lit(0)))
    each = sized.select("item_id", "seg", "start", "step", "speaker", F.posexplode("tokens").alias("pos", "word"))
    at = F.col("pos") * F.col("step")
    return each.select(
        "item_id", "seg", (F.col("seg").cast("bigint") * 1000000 + F.col("pos")).alias("seq"), F.col("word").alias("text"), "speaker",
        (F.col("start") + at).alias("start"), (F.col("start") + (F.col("pos") + 1) * F.col("step")).alias("end"),
    )


def read_call_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Call transcripts, one JSON array of segments per file; item_id is the file's stem."""
    rows = spark.read.schema(CALL_SEGMENT).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.withColumn("item_id", F.regexp_replace(name, r"\.json$", ""))


def call_segments(transcript: DataFrame) -> DataFrame:
    """Reference segments of calls: blank human text skipped, times from the offset, `seg` keeping
    the (offset, index) order."""
    text = F.trim(F.regexp_replace(F.coalesce("human_transcript", F.lit("")), r"(?U)^\s+|\s+$", ""))
    start = F.col("offset_ms") / F.lit(1000.0)
    seg = F.col("offset_ms") * 1000 + F.coalesce("index", F.lit(0))
    return transcript.where(text != "").select(
        "item_id", seg.cast("bigint").alias("seg"), start.alias("start"), (start + F.col("duration_ms") / F.lit(1000.0)).alias("end"), F.col("speaker_role").alias("speaker"), text.alias("text")
    )


def read_meeting_words(spark: SparkSession, path: str) -> DataFrame:
    """`<w>` elements of word files; item_id and agent come from names like ES2002a.A.words.xml."""
    schema = "starttime double, endtime double, punc string, value string"
    return _xml(spark, path, "w", schema.replace("value", "_VALUE"))


def read_meeting_segments(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "segment", "transcriber_start double, transcriber_end double")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").option("valueTag", "_VALUE").schema(schema).load(path)
    parts = F.split(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.")
    return rows.withColumns({"item_id": F.get(parts, 0), "agent": F.get(parts, 1)})


def read_meeting_speakers(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, agent, speaker): the global name behind each agent letter of a meeting."""
    schema = "observation string, speaker array<struct<nxt_agent:string,global_name:string>>"
    rows = spark.read.format("xml").option("rowTag", "meeting").option("attributePrefix", "").schema(schema).load(path)
    each = rows.select(F.col("observation").alias("item_id"), F.explode("speaker").alias("s"))
    return each.where((F.col("s.nxt_agent") != "") & (F.col("s.global_name") != "")).select("item_id", F.col("s.nxt_agent").alias("agent"), F.col("s.global_name").alias("speaker"))


def _named(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    return rows.join(speakers, ["item_id", "agent"], "left").withColumn("speaker", F.coalesce("speaker", "agent"))


def meeting_words(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Timed words: punctuation and untimed or empty elements left out."""
    text = F.trim(F.coalesce("_VALUE", F.lit("")))
    kept = rows.where((F.coalesce("punc", F.lit("")) != "true") & F.col("starttime").isNotNull() & F.col("endtime").isNotNull() & (text != ""))
    return _named(kept, speakers).select("item_id", "speaker", text.alias("text"), F.col("starttime").alias("start"), F.col("endtime").alias("end"))


def meeting_segments(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    kept = rows.where(F.col("transcriber_start").isNotNull() & F.col("transcriber_end").isNotNull())
    return _named(kept, speakers).select("item_id", "speaker", F.col("transcriber_start").alias("start"), F.col("transcriber_end").alias("end"))


def cut_words(words: DataFrame, start: float, end: float) -> DataFrame:
    """Words wholly inside the window, shifted to start at 0."""
    _increasing(start, end)
    kept = words.where((F.col("start") >= start) & (F.col("end") <= end))
    return kept.withColumns({"start": F.col("start") - start, "end": F.col("end") - start})


def cut_segments(segments: DataFrame, start: float, end: float) -> DataFrame:
    """Segments clipped to the window, empty ones dropped, shifted to start at 0."""
    _increasing(start, end)
    clipped = segments.withColumns({"start": F.greatest("start", F.lit(float(start))), "end": F.least("end", F.lit(float(end)))})
    return clipped.where(F.col("end") > F.col("start")).withColumns({"start": F.col("start") - start, "end": F.col("end") - start})


def _increasing(start: float, end: float) -> None:
    if end <= start:
        raise ValueError(f"window must be increasing, got {(start, end)}")


def fill_segments(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with the text of their speaker's words that start inside them."""
    spans = segments.select("item_id", "speaker", F.col("start").alias("s_start"), F.col("end").alias("s_end")).distinct()
    hits = point_join(words.select("item_id", "speaker", "start", "end", "text"), spans, F.col("start"), ("s_start", "s_end"), ["item_id", "speaker"])
    said = hits.groupBy("item_id", "speaker", F.col("s_start").alias("start"), F.col("s_end").alias("end_")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), lambda w: w["text"]), " ").alias("said")
    )
    joined = segments.withColumn("end_", F.col("end")).join(said, ["item_id", "speaker", "start", "end_"], "left")
    return joined.withColumn("text", F.coalesce("said", F.lit(""))).drop("said", "end_")


def reference_speakers(words: DataFrame, segments: DataFrame) -> DataFrame:
    both = words.select("item_id", "speaker").union(segments.select("item_id", "speaker"))
    return both.groupBy("item_id").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """Chapter transcripts of "<id> TEXT" lines as (utterance, text)."""
    return utterance_texts(spark.read.text(path))


def utterance_texts(lines: DataFrame, column: str = "value") -> DataFrame:
    line = F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    parts = F.split(line, " ", 2)
    return lines.where(line != "").select(F.get(parts, 0).alias("utterance"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("text"))


def utterance_reference(texts: DataFrame, items: DataFrame) -> DataFrame:
    """One reader's words without times; `items` gives (item_id, utterance, audio_s)."""
    joined = items.join(texts, "utterance").withColumn("text", F.lower(F.trim("text")))
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    each = joined.select("item_id", F.posexplode(tokens).alias("seq", "text"))
    none = F.lit(None).cast("double")
    return each.select("item_id", "seq", "text", F.lit(READER).alias("speaker"), none.alias("start"), none.alias("end"))


def timed_words(words: DataFrame, items: DataFrame) -> DataFrame:
    """Reference words with times; none of an item annotated without."""
    timed = words.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    return timed.join(items.where(F.col("word_times") != "none").select("item_id"), "item_id", "left_semi")


def not_blank(column: Column) -> Column:
    return F.coalesce(F.trim(column) != "", F.lit(False))
