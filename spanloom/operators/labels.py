"""Speaker attribution: label words from turns, smooth flicker, build lines, count speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import LabelSettings
from spanloom.operators.intervals import overlap_join
from spanloom.operators.scans import Scan, as_of, bucketed_scan, time_bucket
from spanloom.session import settle

UNLABELLED_NAME = "Unknown speaker"
WORD_ORDER = ["start", "end", "seq"]


def best_overlap(words: DataFrame, turns: DataFrame) -> DataFrame:
    """(item_id, seq, label): the turn each word overlaps most, the earlier one on a tie."""
    pairs = overlap_join(
        words.select("item_id", "seq", "start", "end"),
        turns.select("item_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "label"),
        right_span=("t_start", "t_end"),
    )
    shared = F.least("end", "t_end") - F.greatest("start", "t_start")
    first = F.struct((-shared).alias("x"), "t_start", "t_end", "label")
    return pairs.groupBy("item_id", "seq").agg(F.min_by("label", first).alias("label"))


def nearest_turn(words: DataFrame, turns: DataFrame) -> DataFrame:
    """`words` that overlap no turn with `near` (start, end, label) and `distance`, NULL without
    turns: the last turn ending before the word or the first one starting after it."""
    by_end = turns.groupBy("item_id", "end").agg(F.min(F.struct("start", "end", "label")).alias("turn"))
    by_start = turns.groupBy("item_id", "start").agg(F.min(F.struct("start", "end", "label")).alias("turn"))
    found = as_of(words, by_end, ["item_id"], "start", "end", F.col("turn"), "before")
    found = settle(found.withColumn("__rev", -F.col("end")))
    found = as_of(found, by_start.withColumn("__rev", -F.col("start")), ["item_id"], "__rev", "__rev", F.col("turn"), "after")
    back, ahead = F.col("start") - F.col("before.end"), F.col("after.start") - F.col("end")
    options = F.filter(
        F.array(F.struct(back.alias("d"), F.col("before").alias("turn")), F.struct(ahead.alias("d"), F.col("after").alias("turn"))),
        lambda x: x["turn"].isNotNull(),
    )
    return (
        found.withColumn("__best", F.array_min(options))
        .withColumns({"near": F.col("__best.turn"), "distance": F.col("__best.d")})
        .drop("__best", "__rev", "before", "after")
    )


def label_words(words: DataFrame, turns: DataFrame, settings: LabelSettings = LabelSettings()) -> DataFrame:
    """`words` with `label`: by overlap, else the nearest turn within reach, else the previous
    labelled word's, else the next one's. Only a recording without turns stays unlabelled."""
    # A scan reads its input twice, so what scans and joins below read again is settled: otherwise
    # the plan doubles with every step, and the driver holds all of it.
    matched = settle(words.join(best_overlap(words, turns), ["item_id", "seq"], "left"))
    alone = nearest_turn(matched.where(F.col("label").isNull()).select("item_id", "seq", "start", "end"), turns)
    reached = alone.where(F.col("distance") <= settings.max_attach_s).select("item_id", "seq", F.col("near.label").alias("near_label"))
    # Read twice by the fill below.
    chosen = settle(
        matched.join(reached, ["item_id", "seq"], "left").withColumn("label", F.coalesce("label", "near_label")).drop("near_label")
    )
    return fill_labels(chosen)


def fill_labels(words: DataFrame) -> DataFrame:
    filled = bucketed_scan(
        words,
        ["item_id"],
        time_bucket("start"),
        WORD_ORDER,
        [Scan("__prev", "last_before", F.col("label")), Scan("__next", "first_after", F.col("label"))],
    )
    return filled.withColumn("label", F.coalesce("label", "__prev", "__next")).drop("__prev", "__next")


def utterance_of(words: DataFrame, segments: DataFrame) -> DataFrame:
    """`words` with `utterance` (start, end): the last segment starting at or before the word's
    middle, when the middle is not past its end."""
    middle = 0.5 * (F.col("start") + F.col("end"))
    hit = as_of(
        words.withColumn("__mid", middle), segments, ["item_id"], "__mid", "start", F.struct("start", "end"), "__u", tie=F.col("end")
    )
    return hit.withColumn("utterance", F.when(F.col("__mid") <= F.col("__u.end"), F.col("__u"))).drop("__mid", "__u")


def _absorbed(settings: LabelSettings):
    """Left-to-right absorption over the runs of one utterance, for limits so wide that a merged
    run can itself be short."""
    import pandas as pd

    def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run").reset_index(drop=True)
        stack: list[dict] = []
        waiting = [
            {"label": r.label, "n": r.n, "start": r.start, "end": r.end, "runs": [r.run]} for r in pdf.itertuples()
        ]
        changed: dict[int, str] = {}

        def short(run: dict) -> bool:
            return run["n"] < settings.min_run_words and run["end"] - run["start"] < settings.min_run_s

        def join(left: dict, right: dict) -> dict:
            return {**left, "n": left["n"] + right["n"], "end": right["end"], "runs": left["runs"] + right["runs"]}

        position = 0
        while position < len(waiting):
            stack.append(waiting[position])
            position += 1
            while len(stack) >= 3 and stack[-1]["label"] == stack[-3]["label"] and short(stack[-2]):
                right, middle, left = stack.pop(), stack.pop(), stack.pop()
                changed.update({run: left["label"] for run in middle["runs"]})
                stack.append(join(join(left, middle), right))
        pdf["new_label"] = [changed.get(run, label) for run, label in zip(pdf["run"], pdf["label"])]
        pdf["absorbed"] = [run in changed for run in pdf["run"]]
        return pdf[["item_id", "u_start", "u_end", "run", "new_label", "absorbed"]]

    return absorb


def smooth_labels(words: DataFrame, segments: DataFrame, settings: LabelSettings = LabelSettings()) -> DataFrame:
    """`words` with flickers absorbed and `relabelled`, whether the word changed its label.

    Inside an utterance an interior run shorter than both limits whose neighbours share a label
    takes that label, leftmost first. While a merged run (three runs at least) is never short
    itself, the outcome is: in every chain of adjoining candidates the 1st, 3rd, 5th, ... give way.
    """
    keys = ["item_id", "u_start", "u_end"]
    placed = settle(utterance_of(settle(words), segments))
    inside = placed.where(F.col("utterance").isNotNull()).withColumns({"u_start": F.col("utterance.start"), "u_end": F.col("utterance.end")})
    stepped = bucketed_scan(
        inside.drop("utterance"),
        keys,
        time_bucket("start"),
        WORD_ORDER,
        [Scan("__prev", "lag", F.struct("label")), Scan("__n", "sum_before", F.lit(1))],
    )
    starts = F.col("__prev").isNull() | ~F.col("__prev.label").eqNullSafe(F.col("label"))
    marked = settle(stepped.withColumn("__run", F.when(starts, F.col("__n"))).drop("__prev"))
    numbered = bucketed_scan(marked, keys, time_bucket("start"), WORD_ORDER, [Scan("__earlier", "last_before", F.col("__run"))])
    numbered = settle(numbered.withColumn("run", F.coalesce("__run", "__earlier")).drop("__n", "__run", "__earlier"))
    runs = numbered.groupBy(*keys, "run").agg(
        F.first("label").alias("label"), F.count("*").alias("n"), F.min("start").alias("start"),
        F.max_by("end", F.struct(*WORD_ORDER)).alias("end"),
    )
    if settings.min_run_words > 3:
        schema = "item_id long, u_start double, u_end double, run long, new_label string, absorbed boolean"
        schema = schema.replace("item_id long", f"item_id {dict(words.dtypes)['item_id']}")
        decided = runs.groupBy(*keys).applyInPandas(_absorbed(settings), schema)
    else:
        decided = _native_absorption(settle(runs), keys, settings)
    back = numbered.join(decided, [*keys, "run"]).withColumns({"label": F.col("new_label"), "relabelled": F.col("absorbed")})
    outside = placed.where(F.col("utterance").isNull()).withColumn("relabelled", F.lit(False))
    return back.select(*words.columns, "relabelled").unionByName(outside.select(*words.columns, "relabelled"))


def _native_absorption(runs: DataFrame, keys: list[str], settings: LabelSettings) -> DataFrame:
    sided = bucketed_scan(
        runs,
        keys,
        time_bucket("start"),
        ["start", "run"],
        [Scan("prev", "lag", F.struct("label")), Scan("next", "lead", F.struct("label")), Scan("at", "sum_before", F.lit(1))],
    )
    short = (F.col("n") < settings.min_run_words) & (F.col("end") - F.col("start") < settings.min_run_s)
    candidate = F.col("prev").isNotNull() & F.col("next").isNotNull() & F.col("prev").eqNullSafe(F.col("next")) & short
    sided = settle(sided.withColumn("candidate", candidate))
    chained = bucketed_scan(
        sided, keys, time_bucket("start"), ["start", "run"], [Scan("anchor", "last_before", F.when(~F.col("candidate"), F.col("at")))]
    )
    gives_way = F.col("candidate") & ((F.col("at") - F.col("anchor")) % 2 == 1)
    return chained.select(
        *keys, "run", F.when(gives_way, F.col("prev.label")).otherwise(F.col("label")).alias("new_label"), gives_way.alias("absorbed")
    )


def build_lines(words: DataFrame, settings: LabelSettings = LabelSettings()) -> DataFrame:
    """Lines (item_id, line_key, start, end, speaker, text, words): a new one at a change of
    label, after a long pause, and after `line_words` words."""
    words = settle(words.select("item_id", "seq", "start", "end", "text", "label"))
    stepped = bucketed_scan(
        words,
        ["item_id"],
        time_bucket("start"),
        WORD_ORDER,
        [Scan("__prev", "lag", F.struct("label", "end")), Scan("__n", "sum_before", F.lit(1))],
    )
    breaks = (
        F.col("__prev").isNull()
        | ~F.col("__prev.label").eqNullSafe(F.col("label"))
        | (F.col("start") - F.col("__prev.end") > settings.line_gap_s)
    )
    marked = settle(stepped.withColumn("__break", F.when(breaks, F.col("__n"))).drop("__prev"))
    placed = bucketed_scan(marked, ["item_id"], time_bucket("start"), WORD_ORDER, [Scan("__open", "last_before", F.col("__break"))])
    opened = F.coalesce("__break", "__open")
    key = opened + F.floor((F.col("__n") - opened) / settings.line_words) * settings.line_words
    word = F.struct("start", "end", "seq", "text")
    grouped = (
        placed.withColumn("line_key", key.cast("bigint"))
        .groupBy("item_id", "line_key")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("speaker"),
            F.array_sort(F.collect_list(word)).alias("__w"),
        )
    )
    words_out = F.transform("__w", lambda w: F.struct(w["start"].alias("s"), w["end"].alias("e"), w["text"].alias("w"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("int").alias("mark")))
    return grouped.select("item_id", "line_key", "start", "end", "speaker", line_text(F.col("__w"), "text").alias("text"), words_out.alias("words"))


def line_text(words: Column, field: str) -> Column:
    """Stripped non-empty texts of an array of words, joined by one space."""
    stripped = F.transform(words, lambda w: F.regexp_replace(w[field], r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda t: t != ""), " ")


def summarise_speakers(lines: DataFrame) -> DataFrame:
    """Words and seconds per label, `place` by first appearance, unlabelled words last."""
    counts = lines.groupBy("item_id", "speaker").agg(
        F.sum(F.size("words")).alias("words"),
        F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("seconds"),
        F.min(F.struct("start", "end")).alias("first"),
    )
    # One row per label and recording by now, so this window holds a handful of rows.
    order = Window.partitionBy("item_id").orderBy(F.col("speaker").isNull(), "first", "speaker")
    return counts.withColumn("place", F.row_number().over(order)).drop("first")


def named_speakers(counts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """`counts` with `name`: Speaker n by place, or the given (item_id, speaker, name)."""
    named = counts.withColumn("name", F.when(F.col("speaker").isNotNull(), F.concat(F.lit("Speaker "), F.col("place").cast("string"))))
    if names is None:
        return named
    given = names.select("item_id", "speaker", F.col("name").alias("__given"))
    return named.join(given, ["item_id", "speaker"], "left").withColumn("name", F.coalesce("__given", "name")).drop("__given")


def display_name(label: Column, name: Column) -> Column:
    return F.when(label.isNull(), F.lit(UNLABELLED_NAME)).otherwise(F.coalesce(name, label))


def seconds_per_label(turns: DataFrame) -> DataFrame:
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    return turns.groupBy("item_id", "label").agg(F.sum(length).alias("seconds"), F.count("*").alias("turns"))


def renumber(turns: DataFrame) -> DataFrame:
    """Labels speaker_00, speaker_01, ... by first turn, holes closed."""
    firsts = turns.groupBy("item_id", "label").agg(F.min(F.struct("start", "end", "label")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("first")) - 1
    names = firsts.select("item_id", "label", F.format_string("speaker_%02d", rank).alias("__new"))
    return turns.join(names, ["item_id", "label"]).withColumn("label", F.col("__new")).drop("__new")


def embedding_clips(turns: DataFrame, max_seconds: float = 30.0, rate: int = 16000) -> DataFrame:
    """The longest turns of every label until max_seconds are used, the last one clipped; the
    budget is kept in whole samples."""
    first, last = (F.bround(F.col(c) * rate).cast("bigint") for c in ("start", "end"))
    long = turns.withColumns({"first": first, "length": last - first}).where(F.col("length") > 0).withColumn("rank", -F.col("length"))
    used = bucketed_scan(
        long, ["item_id", "label"], F.floor(F.col("rank") / rate).cast("bigint"), ["rank", "start", "end"], [Scan("used", "sum_before", F.col("length"))]
    )
    left = F.lit(int(max_seconds * rate)).cast("bigint") - F.col("used")
    end = (F.col("first") + F.least("length", left)).cast("double") / float(rate)
    return used.where(left > 0).select("item_id", "label", "start", end.alias("end"))


def fold_small_labels(turns: DataFrame, vectors: DataFrame, min_seconds: float = 3.0) -> DataFrame:
    """Labels under min_seconds take the large label with the most similar vector, the one heard
    first on a tie; labels without a vector stay. Recordings where something was folded are
    renumbered, the others stay as they are (no label or every label large, min_seconds 0)."""
    if min_seconds < 0:
        raise ValueError("min_seconds must not be negative")
    totals = turns.groupBy("item_id", "label").agg(
        F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("seconds"), F.min(F.struct("start", "end")).alias("first")
    )
    known = totals.join(vectors.select("item_id", "label", "vec"), ["item_id", "label"])
    small = known.where(F.col("seconds") < min_seconds).select("item_id", F.col("label").alias("small"), F.col("vec").alias("sv"))
    large = known.where(F.col("seconds") >= min_seconds).select("item_id", F.col("label").alias("into"), F.col("vec").alias("lv"), "first")
    pairs = small.join(large, "item_id").withColumn("similarity", cosine("sv", "lv"))
    best = F.min_by("into", F.struct((-F.col("similarity")).alias("x"), "first", "into"))
    folded = settle(pairs.groupBy("item_id", "small").agg(best.alias("into")))
    touched = folded.select("item_id").distinct()
    moved = (
        turns.join(touched, "item_id", "left_semi")
        .join(folded.withColumnRenamed("small", "label"), ["item_id", "label"], "left")
        .withColumn("label", F.coalesce("into", "label"))
        .select(*turns.columns)
    )
    return renumber(moved).select(*turns.columns).unionByName(turns.join(touched, "item_id", "left_anti"))


def cosine(a: str, b: str) -> Column:
    def dot(x: Column | str, y: Column | str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
