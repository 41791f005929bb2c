"""Words from what engines emit: sub-word tokens with times, or segments without word times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.intervals import overlap_join
from spanloom.operators.scans import Scan, bucketed_scan
from spanloom.session import settle

FRAME_S = 0.08
KEYS = ["item_id", "seg"]


def group_words(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """Words from sub-word tokens (item_id, seg, pos, token, time, duration): a leading space opens
    a word. A word ends where its last-ending token ends, at most at the next kept word's start or
    the segment's end; without any duration in the segment, at that next start. Missing times
    repeat the last known one, missing durations are one frame. `segments` gives (item_id, seg,
    end, offset), times relative to the segment's offset."""
    bucket = F.floor(F.col("pos") / 4096)
    timed = bucketed_scan(tokens, KEYS, bucket, ["pos"], [Scan("__last", "last_before", F.col("time")), Scan("__prev", "lag", F.lit(True))])
    timed = timed.withColumns(
        {"time": F.coalesce("time", "__last", F.lit(0.0)), "__open": F.when(F.startswith("token", F.lit(" ")) | F.col("__prev").isNull(), F.col("pos"))}
    ).drop("__last", "__prev")
    # Settled, as the words are below: a scan reads its input twice, and a task would hold the sorts of all of them.
    timed = settle(timed)
    placed = bucketed_scan(timed, KEYS, bucket, ["pos"], [Scan("__from", "last_before", F.col("__open"))])
    end = F.col("time") + F.greatest(F.coalesce("duration", F.lit(FRAME_S)), F.lit(FRAME_S))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "")
    words = (
        placed.withColumn("word", F.coalesce("__open", "__from"))
        .groupBy(*KEYS, "word")
        .agg(text.alias("text"), F.min_by("time", F.struct("pos", "time")).alias("start"), F.max(end).alias("own_end"), F.bool_or(F.col("duration").isNotNull()).alias("has"))
        .withColumn("text", F.regexp_replace("text", "^ ", ""))
        .where(F.col("text") != "")
    )
    words = settle(words)
    known = tokens.groupBy(*KEYS).agg(F.bool_or(F.col("duration").isNotNull()).alias("with_durations"))
    following = bucketed_scan(words, KEYS, F.floor(F.col("word") / 4096), ["word"], [Scan("next", "lead", F.col("start"))])
    joined = following.join(known, KEYS).join(segments.select(*KEYS, F.col("end").alias("seg_end"), "offset"), KEYS)
    limit = F.coalesce("next", "seg_end")
    stop = F.when(F.col("with_durations"), F.least("own_end", limit)).otherwise(limit)
    stop = F.greatest(stop, F.col("start"))
    return joined.select(*KEYS, F.col("word").alias("seq"), "text", (F.col("start") + F.col("offset")).alias("start"), (stop + F.col("offset")).alias("end"))


def segment_text(words: DataFrame) -> DataFrame:
    """(item_id, seg, text): the words of each segment joined in order."""
    row = F.struct("seq", F.trim("text").alias("t"))
    return words.groupBy(*KEYS).agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(row)), lambda w: w["t"]), lambda t: t != ""), " ").alias("text"))


def segment_spans(segments: DataFrame) -> DataFrame:
    """Segments (item_id, window, seg, start, duration, text, window_len, offset) clamped to their
    window; an empty span runs to the next segment's start."""
    keys = ["item_id", "window"]
    stepped = bucketed_scan(segments, keys, F.floor(F.col("seg") / 4096), ["seg"], [Scan("next", "lead", F.col("start"))])
    clamp = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    zero, size = F.lit(0.0), F.col("window_len")
    stepped = stepped.withColumn("b", clamp(F.col("start"), zero, size))
    stepped = stepped.withColumn("e", clamp(F.col("start") + F.col("duration"), F.col("b"), size))
    longer = clamp(F.greatest(F.coalesce("next", size), F.col("b")), F.col("b"), size)
    end = F.when(F.col("e") <= F.col("b"), longer).otherwise(F.col("e"))
    return stepped.select(*keys, "seg", "text", (F.col("b") + F.col("offset")).alias("start"), (end + F.col("offset")).alias("end"))


def spread_over_speech(spans: DataFrame, voiced: DataFrame | None = None) -> DataFrame:
    """Words of each span weighted by length and laid over its voiced parts, so that none lies in
    a pause: a start on a part's border belongs to the next part, an end to the earlier one."""
    keys = ["item_id", "window", "seg"]
    parts = spans.select(*keys, F.struct("start", "end").alias("p"), F.lit(None).cast("struct<start:double,end:double>").alias("v"))
    if voiced is not None:
        hits = overlap_join(spans.select(*keys, "start", "end"), voiced.select("item_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")))
        cut = F.struct(F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
        parts = parts.unionByName(hits.select(*keys, F.lit(None).cast("struct<start:double,end:double>").alias("p"), cut.alias("v")).where(F.col("v.end") > F.col("v.start")))
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("v"), F.first("p", ignorenulls=True).alias("p"))
    listed = listed.select(*keys, F.when(F.size("v") > 0, F.col("v")).otherwise(F.array("p")).alias("parts"))
    # `from`: where each part begins on the clock that runs over the parts only.
    start = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<struct<from:double,start:double,len:double>>").alias("out"))
    laid = F.aggregate(
        "parts", start,
        lambda a, p: F.struct((a["t"] + p["end"] - p["start"]).alias("t"), F.concat(a["out"], F.array(F.struct(a["t"].alias("from"), p["start"].alias("start"), (p["end"] - p["start"]).alias("len")))).alias("out")),
    )
    listed = listed.withColumn("laid", laid).select(*keys, F.col("laid.t").alias("total"), F.col("laid.out").alias("clock"))
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    words = spans.select(*keys, tokens.alias("tokens")).where(F.size("tokens") > 0)
    weights = F.transform("tokens", lambda t: F.length(t) + 1)
    words = words.withColumns({"weights": weights, "all": F.aggregate(weights, F.lit(0), lambda a, w: a + w)})
    run = F.aggregate("weights", F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))
    each = words.withColumn("run", run).join(listed, keys).select(*keys, "all", "run", "total", "clock", F.posexplode("tokens").alias("pos", "text"))

    def real(share, for_start: bool):
        t = F.col("total") * share / F.col("all")
        fits = (lambda p: p["from"] <= t) if for_start else (lambda p: (p["from"] < t) | (p["from"] == 0.0))
        part = F.element_at(F.filter("clock", fits), -1)
        return F.least(part["start"] + (t - part["from"]), part["start"] + part["len"])

    begin, end = real(F.element_at("run", F.col("pos") + 1), True), real(F.element_at("run", F.col("pos") + 2), False)
    return each.select(*keys, "pos", "text", begin.alias("start"), end.alias("end_")).withColumn("end", F.greatest("end_", "start")).drop("end_")


def stream_clock(clips: DataFrame, rate: int = 16000) -> DataFrame:
    """`clips` (item_id, start, end) with stream_start: where each begins when they are joined."""
    first, last = (F.bround(F.col(c) * rate).cast("bigint") for c in ("start", "end"))
    sized = clips.withColumns({"first": first, "size": last - first}).where(F.col("size") > 0)
    placed = bucketed_scan(sized, ["item_id"], F.floor(F.col("start") / 600.0).cast("bigint"), ["start", "end"], [Scan("before", "sum_before", F.col("size"))])
    return placed.select(
        "item_id", (F.col("before") / F.lit(float(rate))).alias("stream_start"), (F.col("first") / F.lit(float(rate))).alias("clip_start"),
        ((F.col("first") + F.col("size")) / F.lit(float(rate))).alias("clip_end"),
    )


def restore_times(rows: DataFrame, clock: DataFrame, column: str) -> DataFrame:
    """`column`, a time in the joined stream, put back on the recording's clock."""
    from spanloom.operators.scans import as_of

    head = clock.groupBy("item_id").agg(F.min(F.struct("stream_start", "clip_start", "clip_end")).alias("__head"))
    hit = as_of(rows, clock, ["item_id"], column, "stream_start", F.struct("stream_start", "clip_start", "clip_end"), "__hit")
    joined = hit.join(head, "item_id", "left").withColumn("__hit", F.coalesce("__hit", "__head"))
    back = F.least(F.col("__hit.clip_end"), F.col("__hit.clip_start") + F.greatest(F.lit(0.0), F.col(column) - F.col("__hit.stream_start")))
    return joined.withColumn(column, F.coalesce(back, F.col(column))).drop("__hit", "__head")
