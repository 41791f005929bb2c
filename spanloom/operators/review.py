"""Where one source is silent and another is not: marks, their evaluation, what to re-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import ReviewSettings
from spanloom.functions.text import normalized
from spanloom.operators.intervals import (
    complement,
    overlap_join,
    overlapping,
    union_seconds,
    union_spans,
)
from spanloom.operators.scans import numbered, time_bucket
from spanloom.session import settle

# Word times come from decimal seconds; length and border tests carry this tolerance.
TOLERANCE = 1e-9

SPAN = ["item_id", "span_start", "span_end"]

CHUNK = 4096  # positions of words by which buckets and probes meet


def silent_spans(published: DataFrame, items: DataFrame) -> DataFrame:
    """Stretches of [0, audio_s] no published word covers, leading and trailing ones included."""
    extents = items.select("item_id", F.lit(0.0).alias("lo"), F.col("audio_s").alias("hi"))
    return complement(published, extents)


def checking_windows(published: DataFrame, items: DataFrame, settings: ReviewSettings = ReviewSettings()) -> DataFrame:
    """Silent spans long enough, widened by the margin, clamped and merged."""
    wide = (
        silent_spans(published, items)
        .where(F.col("end") - F.col("start") >= settings.min_silence_s)
        .join(items.select("item_id", "audio_s"), "item_id")
        .select(
            "item_id",
            F.greatest(F.lit(0.0), F.col("start") - settings.margin_s).alias("start"),
            F.least("audio_s", F.col("end") + settings.margin_s).alias("end"),
        )
    )
    return union_spans(wide, keep_empty=True)


def speech_within(windows: DataFrame, speech: DataFrame) -> DataFrame:
    """Windows intersected with speech, touching pieces merged."""
    pairs = overlap_join(windows, speech.select("item_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")))
    cut = pairs.select("item_id", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    return union_spans(cut)


def targeted_check(published: DataFrame, speech: DataFrame, items: DataFrame, settings: ReviewSettings = ReviewSettings()) -> DataFrame:
    """What a second source must process when it checks only where the publisher is silent."""
    return speech_within(checking_windows(published, items, settings), speech)


def border_words(spans: DataFrame, published: DataFrame, detector: DataFrame) -> DataFrame:
    """For every span (with `n`, the words inside): the last n words of each source ending
    before it and the first n starting after it, as arrays of normal forms in time order. A probe takes
    them from its own time bucket; only what is left comes from buckets beside it, by a join."""
    words = published.select("item_id", F.lit("p").alias("source"), "seq", "start", "end", "text").unionByName(
        detector.select("item_id", F.lit("d").alias("source"), "seq", "start", "end", "text")
    )
    # One row per word and side: by end for the words before a span, by start for those after.
    sides = F.array(
        F.struct(F.lit("b").alias("side"), F.col("end").alias("t"), F.col("start").alias("u")),
        F.struct(F.lit("a").alias("side"), F.col("start").alias("t"), F.col("end").alias("u")),
    )
    rows = words.select("item_id", "source", "seq", "text", F.inline(sides)).withColumn("flag", F.lit(0))
    probes = F.array(
        *[
            F.struct(F.lit(source).alias("source"), F.lit(side).alias("side"), t.alias("t"), F.lit(flag).alias("flag"))
            for source in ("p", "d")
            for side, t, flag in (
                ("b", F.col("span_start") + TOLERANCE, 1),
                ("a", F.col("span_end") - TOLERANCE, -1),
            )
        ]
    )
    asks = spans.select("item_id", F.struct("span_start", "span_end", F.col("n").cast("long").alias("n")).alias("ask"), F.inline(probes))
    keys = ["item_id", "source", "side"]
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn("__b", time_bucket("t")).where(F.col("__b").isNotNull())
    # A row per bucket: its words in order, and its probes with the number of its words before each.
    entry = F.struct("t", "flag", "u", "seq", "text", "ask")
    blocks = both.groupBy(*keys, "__b").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    asked = F.filter(F.transform("all", lambda x, i: F.struct(x["ask"].alias("ask"), i.alias("i"))), lambda x: x["ask"].isNotNull())
    texts = F.transform(F.filter("all", lambda x: x["ask"].isNull()), lambda x: x["text"])
    blocks = blocks.select(*keys, "__b", asked.alias("asked"), texts.alias("texts"))
    blocks = settle(blocks.withColumn("asked", F.transform("asked", lambda x, j: F.struct(x["ask"].alias("ask"), (x["i"] - j).alias("at")))))
    before = F.col("side") == "b"

    def taken(x: Column) -> Column:
        """The words of a probe's own bucket among its n, and how many are left to its neighbours."""
        n, at = x["ask"]["n"], x["at"]
        here = F.least(n, F.when(before, at).otherwise(F.size("texts") - at)).cast("int")
        own = F.slice("texts", F.when(before, at - here).otherwise(at) + 1, here)
        return F.struct(x["ask"]["span_start"].alias("span_start"), x["ask"]["span_end"].alias("span_end"), own.alias("own"), (n - here).alias("left"))

    near = blocks.select(*keys, "__b", F.inline(F.transform("asked", taken)))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # Of the buckets only their sizes go through the window.
    sizes = blocks.select(*keys, "__b", F.size("texts").cast("long").alias("size"))
    sizes = sizes.withColumn("from", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    far = near.where(F.col("left") > 0).drop("own").join(sizes, [*keys, "__b"])
    first = F.when(before, F.greatest(F.col("from") - F.col("left"), F.lit(0))).otherwise(F.col("from") + F.col("size"))
    last = F.when(before, F.col("from") - 1).otherwise(F.col("from") + F.col("size") + F.col("left") - 1)
    far = far.select(*keys, "span_start", "span_end", first.alias("first"), last.alias("last")).where(F.col("last") >= F.col("first"))
    chunk = lambda c: F.floor(c / CHUNK)
    far = far.withColumn("chunk", F.explode(F.sequence(chunk(F.col("first")), chunk(F.col("last")))))
    end = F.col("from") + F.col("size")
    met = sizes.where(F.col("size") > 0).withColumn("chunk", F.explode(F.sequence(chunk(F.col("from")), chunk(end - 1))))
    begin = F.greatest("first", "from")
    # A probe and a bucket meet in the chunk of their first common word.
    met = far.join(met, [*keys, "chunk"]).where((F.col("first") < end) & (F.col("from") <= F.col("last")) & (F.col("chunk") == chunk(begin)))
    met = met.join(blocks.select(*keys, "__b", "texts"), [*keys, "__b"])
    piece = F.slice("texts", (begin - F.col("from") + 1).cast("int"), (F.least(F.col("last") + 1, end) - begin).cast("int"))
    pieces = near.drop("left").unionByName(met.select(*keys, "__b", "span_start", "span_end", piece.alias("own")))
    found = pieces.select(*keys, "__b", "span_start", "span_end", F.posexplode("own").alias("at", "text"))
    found = normalized(found, "text", "norm")

    def side(source: str, which: str, name: str) -> Column:
        here = F.when((F.col("source") == source) & (F.col("side") == which), F.struct("__b", "at", "norm"))
        return F.transform(F.sort_array(F.collect_list(here)), lambda x: x["norm"]).alias(name)

    return found.groupBy(*SPAN).agg(
        side("p", "b", "before"), side("p", "a", "after"), side("d", "b", "d_before"), side("d", "a", "d_after")
    )


def _ends_equal(run: Column, count: Column, other: Column, at_end: bool) -> Column:
    """Whether the first (last) `count` of `run` equal the last (first) `count` of `other`."""
    if at_end:
        mine, theirs = F.slice(run, F.size(run) - count + 1, count), F.slice(other, F.lit(1), count)
        quick = (F.element_at(run, -count) == F.element_at(other, 1)) & (F.element_at(run, -1) == F.element_at(other, count))
    else:
        mine, theirs = F.slice(run, F.lit(1), count), F.slice(other, F.size(other) - count + 1, count)
        quick = (F.element_at(run, 1) == F.element_at(other, -count)) & (F.element_at(run, count) == F.element_at(other, -1))
    # The two border words are compared first; whole slices only where both agree.
    return F.when(quick, (mine == theirs) & ~F.array_contains(mine, "")).otherwise(F.lit(False))


def echo_length(run: Column, border: Column, own: Column, at_end: bool) -> Column:
    """Words at the head (tail) of `run` that repeat the bordering words of the other source: the
    longest match, and none when `own`, the run's own source, has the same words there too."""
    limit = F.least(F.size(run), F.size(border))
    match = F.array_max(F.filter(F.sequence(F.lit(1), limit), lambda c: _ends_equal(run, c, border, at_end)))
    # sequence(1, 0) counts down, so the empty case is decided before it.
    longest = F.when(limit >= 1, F.coalesce(match, F.lit(0))).otherwise(F.lit(0))
    repeated = F.when(
        (longest >= 1) & (F.size(own) >= longest), _ends_equal(run, longest, own, at_end)
    ).otherwise(F.lit(False))
    return F.when(repeated, F.lit(0)).otherwise(longest)


def echoes_removed(df: DataFrame) -> DataFrame:
    """`words` (array of structs with `norm`) without echoes of before / after."""
    norms = F.transform("words", lambda w: w["norm"])
    df = df.withColumn("norms", norms)
    df = df.withColumn("head", echo_length(F.col("norms"), F.col("before"), F.col("d_before"), at_end=False))
    rest = F.slice("norms", F.col("head") + 1, F.size("norms") - F.col("head"))
    df = df.withColumn("norms", rest)
    df = df.withColumn("tail", echo_length(F.col("norms"), F.col("after"), F.col("d_after"), at_end=True))
    kept = F.slice("words", F.col("head") + 1, F.size("words") - F.col("head") - F.col("tail"))
    return df.withColumn("words", kept).drop("norms", "head", "tail", "before", "after", "d_before", "d_after")


def candidate_spans(published: DataFrame, detector: DataFrame, items: DataFrame, settings: ReviewSettings = ReviewSettings()) -> DataFrame:
    """Silent spans long enough, with the detector words inside, before echo removal."""
    silent = silent_spans(published, items).where(F.col("end") - F.col("start") + TOLERANCE >= settings.min_silence_s)
    # Few rows next to the words; the join asks for their lengths first.
    spans = settle(silent.select("item_id", F.col("start").alias("span_start"), F.col("end").alias("span_end")))
    pairs = overlap_join(spans, detector.select("item_id", "seq", "start", "end", "text"), ("item_id",), ("span_start", "span_end"), ("start", "end"))
    word = F.struct("start", "end", "seq", "text", "norm")
    filled = (
        normalized(pairs, "text", "norm")
        .groupBy(*SPAN)
        .agg(F.sort_array(F.collect_list(word)).alias("words"))
        .where(F.size("words") >= settings.min_detector_words)
    )
    if settings.min_detector_words == 0:
        filled = spans.join(filled, SPAN, "left").withColumn("words", F.coalesce("words", F.array().cast(filled.schema["words"].dataType)))
    return filled.withColumn("n", F.size("words"))


def build_review(published: DataFrame, detector: DataFrame, items: DataFrame, settings: ReviewSettings = ReviewSettings()) -> DataFrame:
    """Marks (item_id, mark, start, end, span_start, span_end, detector_words, detector_text)."""
    # Few rows next to the words, read twice below.
    spans = settle(candidate_spans(published, detector, items, settings))
    borders = border_words(spans.select(*SPAN, "n"), published, detector)
    empty = F.array().cast("array<string>")
    full = spans.join(borders, SPAN, "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("before", "after", "d_before", "d_after")}
    )
    # Settled before the filter: pushed down, the filter would repeat the echo test many times over.
    kept = settle(echoes_removed(full)).where(F.size("words") >= settings.min_detector_words)
    pieces = F.filter(F.transform("words", lambda w: F.regexp_replace(w["text"], r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    marks = kept.join(items.select("item_id", "audio_s"), "item_id").select(
        "item_id",
        F.greatest(F.lit(0.0), F.col("span_start") - settings.pad_s).alias("start"),
        F.least("audio_s", F.col("span_end") + settings.pad_s).alias("end"),
        "span_start",
        "span_end",
        F.size("words").alias("detector_words"),
        F.array_join(pieces, " ").alias("detector_text"),
    )
    return numbered(marks, ["item_id"], time_bucket("span_start"), ["span_start"], "mark")


def dropped_words(published: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference words no published word overlaps."""
    return overlapping(reference, published, ["seq"], keep=False)


def marks_on_speech(marks: DataFrame, reference: DataFrame) -> DataFrame:
    return overlapping(marks, reference, ["span_start"], left_span=("span_start", "span_end"))


def covered_words(dropped: DataFrame, marks: DataFrame) -> DataFrame:
    return overlapping(dropped, marks, ["seq"], right_span=("span_start", "span_end"))


def ratio(numerator: Column, denominator: Column, otherwise: Column | None = None) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0) if otherwise is None else otherwise)


def evaluate_review(marks: DataFrame, published: DataFrame, reference: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item: counts, precision, recall, and the audio the marks ask to hear."""
    # Few rows next to the words, and read again by the joins below.
    marks = settle(marks)
    dropped = settle(dropped_words(published, reference).select("item_id", "seq", "start", "end"))
    zero = F.lit(0).cast("bigint")

    def measure(df: DataFrame, name: str, value: Column) -> DataFrame:
        columns = {c: zero for c in ("marks", "marks_on_speech", "dropped_words", "dropped_covered")}
        columns["audio_to_review_s"] = F.lit(0.0)
        columns[name] = value
        return df.select("item_id", *[v.alias(k) for k, v in columns.items()])

    one = F.lit(1).cast("bigint")
    parts = measure(items, "marks", zero)
    for part in (
        measure(marks, "marks", one),
        measure(marks_on_speech(marks, reference), "marks_on_speech", one),
        measure(dropped, "dropped_words", one),
        measure(covered_words(dropped, marks), "dropped_covered", one),
        measure(union_seconds(marks), "audio_to_review_s", F.col("seconds")),
    ):
        parts = parts.unionByName(part)
    names = ["marks", "marks_on_speech", "dropped_words", "dropped_covered", "audio_to_review_s"]
    totals = parts.groupBy("item_id").agg(*[F.sum(n).alias(n) for n in names])
    return (
        totals.join(items.select("item_id", "audio_s"), "item_id")
        .withColumns(
            {
                "precision": ratio(F.col("marks_on_speech"), F.col("marks")),
                "recall": ratio(F.col("dropped_covered"), F.col("dropped_words")),
                "audio_to_review_fraction": ratio(F.col("audio_to_review_s"), F.col("audio_s")),
            }
        )
        .drop("audio_s")
    )


def review_scores(published: DataFrame, detector: DataFrame, reference: DataFrame, items: DataFrame, settings: ReviewSettings = ReviewSettings()) -> DataFrame:
    """Marks scored against the reference. `items` carries word_times (annotated, spread, none);
    without timed words only the marks and the plain sum of their windows are known."""
    marks = settle(build_review(published, detector, items, settings))
    timed = reference.where(F.col("start").isNotNull() & F.col("end").isNotNull()).join(
        items.where(F.col("word_times") != "none").select("item_id"), "item_id", "left_semi"
    )
    full = evaluate_review(marks, published, timed, items)
    plain = marks.groupBy("item_id").agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("plain_s"))
    has_words = timed.select("item_id").distinct().withColumn("evaluated", F.lit(True))
    joined = (
        full.join(plain, "item_id", "left")
        .join(has_words, "item_id", "left")
        .join(items.select("item_id", "word_times"), "item_id")
        .withColumns({"evaluated": F.coalesce("evaluated", F.lit(False)), "approximate": F.col("word_times") == "spread"})
    )
    scored = ["marks_on_speech", "precision", "dropped_words", "dropped_covered", "recall", "audio_to_review_fraction"]
    return joined.withColumns(
        {
            **{c: F.when(F.col("evaluated"), F.col(c)) for c in scored},
            "audio_to_review_s": F.when(F.col("evaluated"), F.col("audio_to_review_s")).otherwise(F.coalesce("plain_s", F.lit(0.0))),
        }
    ).drop("plain_s", "word_times")


def mark_resolution(marks: DataFrame, session: DataFrame) -> DataFrame:
    """Each mark's decision: the one recorded on it, else the session's, NULL while open;
    `recorded` tells whether the mark itself carries it."""
    theirs = session.select("item_id", "mark", F.col("status").alias("s_status"), F.col("note").alias("s_note"))
    own = F.coalesce(F.col("status") != "open", F.lit(False))
    other = F.coalesce(F.col("s_status") != "open", F.lit(False))
    picked = {
        "recorded": own,
        "note": F.when(own, F.col("note")).when(other, F.col("s_note")),
        "status": F.when(own, F.col("status")).when(other, F.col("s_status")),
    }
    return marks.join(theirs, ["item_id", "mark"], "left").withColumns(picked).drop("s_status", "s_note")


def summary_text(evaluation: DataFrame) -> DataFrame:
    """One sentence per item from `evaluate_review`'s figures."""
    n = F.col("marks")
    text = F.concat(
        F.format_string("%d %s covering %.1f%% of the recording", n, F.when(n == 1, "mark").otherwise("marks"), F.col("audio_to_review_fraction") * 100.0),
        F.format_string("; %d of %d on real speech", "marks_on_speech", n),
        F.format_string("; marks cover %.0f%% of dropped words (%d of %d)", F.col("recall") * 100.0, "dropped_covered", "dropped_words"),
    )
    return evaluation.select("item_id", text.alias("summary"))
