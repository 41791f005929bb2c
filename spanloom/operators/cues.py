"""Subtitles: balanced chunks, cues, SRT and VTT blocks; and the line-per-row text rendering."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from spanloom.config import CueSettings
from spanloom.functions import wording as wd
from spanloom.operators.align import _listed
from spanloom.operators.labels import UNLABELLED_NAME
from spanloom.operators.scans import Scan, bucketed_scan, time_bucket
from spanloom.session import settle

SCENE_CUE_KINDS = ("music", "noise", "sound")
LISTENER = "listener"
HEARD = "heard on review"
UNKNOWN_PASSES = 7


def _cut_places(settings: CueSettings):
    """Where the chunks of each line begin (1-based): all lines of a batch are halved at once, by the
    sums of the words' sizes over the whole batch."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def places(sizes: pa.Array, starts: pa.Array, ends: pa.Array, prefixes: pa.Array) -> pa.Array:
        (bounds, sizes), (_, starts), (_, ends) = map(_listed, (sizes, starts, ends))
        numbers, known = (lambda x: x.to_numpy(zero_copy_only=False)), (lambda x: x.is_valid().to_numpy(zero_copy_only=False))
        timed_start, timed_end, prefixed = map(known, (starts, ends, prefixes))
        starts, ends, prefixes = numbers(starts), numbers(ends), numbers(prefixes.fill_null(0))
        total = np.concatenate([[0], np.cumsum(numbers(sizes), dtype=np.int64)])
        line = np.flatnonzero(np.diff(bounds))
        begin, end = bounds[line].astype(np.int64), bounds[line + 1].astype(np.int64)
        opens = np.zeros(len(sizes), dtype=bool)
        opens[begin] = True
        for count in itertools.count():
            with np.errstate(invalid="ignore"):
                timed, wide = timed_start[begin] & timed_end[end - 1], ~(ends[end - 1] - starts[begin] <= settings.max_seconds)
            long = prefixed[line] & (prefixes[line] + total[end] - total[begin] - 1 > settings.max_chars) | timed & wide
            several = end - begin > 1
            left = several & (long | ~timed | ~prefixed[line])
            if count == UNKNOWN_PASSES:
                going = np.zeros(len(bounds), dtype=bool)
                going[line[several & long]] = True
                left &= going[line]
            begin, end, line = begin[left], end[left], line[left]
            if not len(line):
                break
            # Twice the middle, so that it is whole; the boundary before it wins a tie.
            middle = total[begin] + total[end]
            at = np.searchsorted(2 * total, middle)
            lower, upper = np.maximum(at - 1, begin + 1), np.minimum(at, end - 1)
            at = np.where(middle - 2 * total[lower] <= 2 * total[upper] - middle, lower, upper)
            opens[at] = True
            begin, end, line = np.concatenate([begin, at]), np.concatenate([at, end]), np.concatenate([line, line])
        cuts = np.flatnonzero(opens)
        line = np.searchsorted(bounds, cuts, side="right") - 1
        sums = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(bounds) - 1))])
        return pa.ListArray.from_arrays(pa.array(sums, pa.int32()), pa.array(cuts - bounds[line] + 1, pa.int32()))

    return places


def balanced_chunks(lines: DataFrame, settings: CueSettings = CueSettings()) -> DataFrame:
    """`lines` (with words and prefix) with `chunks`: the words halved at the boundary nearest the
    middle by characters, until each chunk fits or is one word. Chunks of unknown length (no times, no
    prefix) are halved too, in seven passes unless the line has one that is known to be too long."""
    spoken = lines.where(F.exists("words", lambda w: F.trim(w["w"]) != ""))
    kept = F.filter("words", lambda w: F.trim(w["w"]) != "")
    sized = F.transform(kept, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), F.trim(w["w"]).alias("w"), (F.length(F.trim(w["w"])) + 1).alias("len")))
    df = spoken.withColumn("__words", sized)
    df = df.withColumn("__at", _cut_places(settings)(F.col("__words.len"), F.col("__words.s"), F.col("__words.e"), F.length("prefix")))
    upto = lambda i: F.coalesce(F.get("__at", i + 1), F.size("__words") + 1)
    return df.withColumn("chunks", F.transform("__at", lambda at, i: F.slice("__words", at, upto(i) - at))).drop("__words", "__at")


def build_cues(lines: DataFrame, scenes: DataFrame, names: DataFrame, settings: CueSettings = CueSettings()) -> DataFrame:
    """Cues (item_id, cue, start, end, text) from lines, scenes and (item_id, speaker, name)."""
    named = lines.join(names.select("item_id", "speaker", F.col("name").alias("__name")), ["item_id", "speaker"], "left")
    shown = F.when(F.col("speaker").isNull(), F.lit(UNLABELLED_NAME)).otherwise(F.coalesce("__name", "speaker"))
    if "src" in lines.columns:
        shown = F.when(F.col("src") == LISTENER, F.concat(shown, F.lit(f" ({HEARD})"))).otherwise(shown)
    chunked = balanced_chunks(named.withColumn("prefix", F.concat(shown, F.lit(": "))), settings)
    # Every line has a chunk; for a plain explode Spark would add a filter that makes the chunks once more.
    each = chunked.select("item_id", "prefix", F.explode_outer("chunks").alias("c"))
    spoken = each.select(
        "item_id", F.element_at("c", 1)["s"].alias("start"), F.element_at("c", -1)["e"].alias("end"),
        F.concat("prefix", F.array_join("c.w", " ")).alias("text"),
    ).withColumn("text", wd.split_rows("text", settings.row_chars))
    heard = scenes.where(F.col("kind").isin(*SCENE_CUE_KINDS) & (F.col("end") - F.col("start") >= settings.min_scene_s)).select(
        "item_id", "start", "end", wd.scene_tag().alias("text")
    )
    order = ["start", "end", "text"]
    # Settled: the scan reads the cues twice.
    cues = bucketed_scan(
        settle(spoken.unionByName(heard)), ["item_id"], time_bucket("start"), order,
        [Scan("__next", "lead", F.col("start")), Scan("cue", "sum_before", F.lit(1))],
    )
    longer = F.greatest(F.col("end"), F.col("start") + settings.min_seconds)
    end = F.when(F.col("__next").isNull(), longer).when(F.col("__next") > F.col("end"), F.least(longer, F.col("__next"))).otherwise(F.col("end"))
    return cues.select("item_id", (F.col("cue") + 1).alias("cue"), "start", end.alias("end"), "text")


def srt_blocks(cues: DataFrame) -> DataFrame:
    """One numbered block per cue; the file of an item is its blocks in order, joined by newlines."""
    block = F.concat(
        F.col("cue").cast("string"), F.lit("\n"), wd.cue_time("start", ","), F.lit(" --> "), wd.cue_time("end", ","), F.lit("\n"), F.col("text"), F.lit("\n")
    )
    return cues.select("item_id", F.col("cue").alias("at"), block.alias("value"))


def vtt_blocks(cues: DataFrame) -> DataFrame:
    block = F.concat(wd.cue_time("start", "."), F.lit(" --> "), wd.cue_time("end", "."), F.lit("\n"), F.col("text"), F.lit("\n"))
    head = cues.select("item_id").distinct().select("item_id", F.lit(0).cast("bigint").alias("at"), F.lit("WEBVTT\n").alias("value"))
    return cues.select("item_id", F.col("cue").cast("bigint").alias("at"), block.alias("value")).unionByName(head)


def transcript_entries(lines: DataFrame, scenes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Lines, scenes and marks on one timeline: at equal starts scene, mark, line."""
    def entry(df: DataFrame, rank: int, kind: str, label: Column, text: Column) -> DataFrame:
        return df.select("item_id", "start", "end", F.lit(rank).alias("rank"), F.lit(kind).alias("entry"), label.alias("label"), text.alias("text"))

    phrase = wd.scene_phrase("kind", "label", "start", "end")
    out = entry(lines, 2, "line", F.col("speaker"), F.col("text")).unionByName(entry(scenes, 0, "scene", F.lit(None).cast("string"), phrase))
    if marks is not None:
        out = out.unionByName(entry(marks, 1, "mark", F.lit(None).cast("string"), F.lit(None).cast("string")))
    return out


def text_runs(words: Column) -> Column:
    """Runs of consecutive words of one source as structs (text, listener)."""
    kept = F.filter(words, lambda w: F.trim(w["w"]) != "")
    empty = F.array().cast("array<struct<text:string,listener:boolean>>")

    def add(acc: Column, w: Column) -> Column:
        listener = F.coalesce(w["src"] == LISTENER, F.lit(False))
        tail = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(F.concat(tail["text"], F.lit(" "), F.trim(w["w"])).alias("text"), listener.alias("listener"))
        fresh = F.struct(F.trim(w["w"]).alias("text"), listener.alias("listener"))
        body = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(tail["listener"] == listener, F.concat(body, F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(kept, empty, add)


def marked_text(words: Column, text: Column, src: Column) -> Column:
    """A line's text with the listener's words in braces."""
    whole = F.when(text == "", F.lit("")).when(src == LISTENER, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(text)
    mixed = F.exists(words, lambda w: F.coalesce(w["src"] == LISTENER, F.lit(False))) & ~F.coalesce(src == LISTENER, F.lit(False))
    braced = F.transform(text_runs(words), lambda r: F.when(r["listener"], F.concat(F.lit("{"), r["text"], F.lit("}"))).otherwise(r["text"]))
    return F.when(mixed, F.array_join(braced, " ")).otherwise(whole)
