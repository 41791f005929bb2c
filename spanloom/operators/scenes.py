"""Non-speech scenes: gap windows, level and class rules, scene merging, set-aside filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import SceneSettings
from spanloom.operators.intervals import complement, point_join, union_spans
from spanloom.operators.scans import Scan, bucketed_scan, time_bucket
from spanloom.operators.series import level_dbfs
from spanloom.session import settle

# ---- fixed values: kinds in reporting order and the sound classes of each family -------------
KINDS = ("silence", "music", "noise", "sound")
SPEECH_CLASSES = (
    "Speech", "Male speech, man speaking", "Female speech, woman speaking", "Child speech, kid speaking",
    "Conversation", "Narration, monologue", "Speech synthesizer", "Shout", "Bellow", "Whoop", "Yell",
    "Children shouting", "Screaming", "Whispering", "Babbling",
)
MUSIC_CLASSES = (
    "Musical instrument", "Singing", "Choir", "A capella", "Synthesizer", "Piano", "Keyboard (musical)",
    "Electric piano", "Organ", "Guitar", "Electric guitar", "Bass guitar", "Acoustic guitar",
    "Plucked string instrument", "Drum", "Drum kit", "Percussion", "Violin, fiddle", "Cello", "Trumpet",
    "Saxophone", "Flute", "Harp", "Rapping", "Humming", "Yodeling", "Chant", "Mantra", "Beatboxing", "Song",
    "Melody", "Strum", "Orchestra", "Bowed string instrument", "Brass instrument",
    "Wind instrument, woodwind instrument", "Accordion", "Harmonica", "Bagpipes", "Ukulele", "Banjo", "Sitar",
    "Mandolin", "Zither",
)
NOISE_CLASSES = (
    "Noise", "White noise", "Pink noise", "Static", "Hum", "Mains hum", "Environmental noise", "Rustle", "Hiss",
    "Wind", "Wind noise (microphone)", "Rustling leaves", "Rain", "Rain on surface", "Raindrop", "Thunderstorm",
    "Thunder", "Water", "Stream", "Waterfall", "Ocean", "Waves, surf", "Gurgling", "Vehicle", "Car",
    "Traffic noise, roadway noise", "Air conditioning", "Mechanical fan", "Engine", "Idling", "Inside, small room",
    "Inside, large room or hall", "Inside, public space", "Outside, urban or manmade", "Outside, rural or natural",
    "Crowd", "Chatter", "Hubbub, speech noise, speech babble", "Fire", "Crackle", "Buzz", "Sine wave", "Silence",
)
# ----------------------------------------------------------------------------------------------

EVENTS = "array<struct<name:string,prob:double>>"


def _is(names: tuple[str, ...]):
    return lambda name: name.isin(*names)


def is_music_class(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("music")) | name.isin(*MUSIC_CLASSES)


is_speech_class, is_noise_class = _is(SPEECH_CLASSES), _is(NOISE_CLASSES)


def family_probability(events: Column, member) -> Column:
    """Largest probability among the events of a family, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(events, lambda e: member(e["name"])), lambda e: e["prob"])), F.lit(0.0))


def top_event(events: Column, member=None) -> Column:
    """The most probable event (of a family), the first listed on a tie."""
    chosen = events if member is None else F.filter(events, lambda e: member(e["name"]))
    ranked = F.transform(chosen, lambda e, i: F.struct((-e["prob"]).alias("x"), i.alias("i"), e["name"].alias("name"), e["prob"].alias("prob")))
    return F.array_min(ranked)


def classify(df: DataFrame, settings: SceneSettings = SceneSettings(), level: str = "level", events: str = "events") -> DataFrame:
    """`df` with kind (NULL for speech), label and probability of each stretch."""
    e, s = F.col(events), settings
    df = df.withColumns(
        {
            "__speech": family_probability(e, is_speech_class),
            "__music": family_probability(e, is_music_class),
            "__noise": family_probability(e, is_noise_class),
            "__tm": top_event(e, is_music_class),
            "__tn": top_event(e, is_noise_class),
            "__top": top_event(e),
            "__quiet": family_probability(e, _is(("Silence",))),
        }
    )
    quiet = F.col(level) < s.silence_dbfs
    speech = F.col("__speech") >= s.speech_keep
    music = (F.col("__music") >= s.music_min) & (F.col("__music") >= F.col("__noise"))
    noise = F.col("__noise") >= s.noise_min
    weak = F.col("__top").isNull() | (F.col("__top.prob") < s.noise_min)
    music_label = F.when(F.col("__tm.name") != "Music", F.col("__tm.name")).otherwise("")
    noise_label = F.when(~F.col("__tn.name").isin("Noise", "Silence"), F.col("__tn.name")).otherwise("")
    kind = F.when(quiet, "silence").when(e.isNull(), "sound").when(speech, F.lit(None)).when(music, "music").when(noise, "noise").otherwise("sound")
    label = (
        F.when(quiet | e.isNull() | speech, "").when(music, music_label).when(noise, noise_label).when(weak, "").otherwise(F.col("__top.name"))
    )
    probability = (
        F.when(quiet, F.when(e.isNull() | (F.size(e) == 0), F.lit(1.0)).otherwise(F.col("__quiet")))
        .when(e.isNull(), F.lit(0.0)).when(speech, F.col("__speech")).when(music, F.col("__music")).when(noise, F.col("__noise"))
        .otherwise(F.coalesce("__top.prob", F.lit(0.0)))
    )
    return df.withColumns({"kind": kind, "label": label, "probability": probability}).drop(
        "__speech", "__music", "__noise", "__tm", "__tn", "__top", "__quiet"
    )


def should_suppress(events: Column, duration: Column, settings: SceneSettings = SceneSettings()) -> Column:
    loud = (family_probability(events, is_music_class) >= settings.confident) | (family_probability(events, is_noise_class) >= settings.confident)
    return events.isNotNull() & (duration >= settings.min_utterance_s) & (family_probability(events, is_speech_class) < settings.speech_suppress) & loud


def gaps_between(spans: DataFrame, items: DataFrame, settings: SceneSettings = SceneSettings()) -> DataFrame:
    extents = items.select("item_id", F.lit(0.0).alias("lo"), F.col("audio_s").alias("hi"))
    return complement(spans, extents).where(F.col("end") - F.col("start") >= settings.min_gap_s)


def split_windows(spans: DataFrame, window_s: float) -> DataFrame:
    """Equal pieces no longer than window_s; the last one ends exactly at the span's end."""
    if window_s <= 0:
        raise ValueError("window_s must be positive")
    length = F.col("end") - F.col("start")
    count = F.greatest(F.lit(1), F.ceil(length / window_s - 1e-9).cast("int"))
    cut = spans.where(length > 0).withColumns({"__n": count, "__step": length / count})
    cut = cut.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    start = F.col("start") + F.col("__i") * F.col("__step")
    end = F.when(F.col("__i") < F.col("__n") - 1, F.col("start") + (F.col("__i") + 1) * F.col("__step")).otherwise(F.col("end"))
    return cut.withColumns({"__s": start, "__e": end}).withColumns({"start": F.col("__s"), "end": F.col("__e")}).drop("__n", "__step", "__i", "__s", "__e")


def pieces(spans: DataFrame, max_samples: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Whole-sample version: equal pieces of at most max_samples, cuts rounded half to even."""
    if max_samples <= 0:
        raise ValueError("max_samples must be positive")
    length = F.col(hi) - F.col(lo)
    count = F.ceil(length / F.lit(float(max_samples))).cast("bigint")
    cut = spans.where(length > 0).withColumns({"__n": count, "__step": length.cast("double") / count})
    cut = cut.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    at = lambda i: F.col(lo) + F.bround(i * F.col("__step")).cast("bigint")
    end = F.when(F.col("__i") == F.col("__n") - 1, F.col(hi)).otherwise(at(F.col("__i") + 1))
    return cut.withColumns({"piece": F.col("__i"), "piece_lo": at(F.col("__i")), "piece_hi": end}).drop("__n", "__step", "__i")


def merge_events(per_piece: DataFrame, top_k: int = 8) -> DataFrame:
    """`events` of regions tagged in pieces: (item_id, start, end, name, prob) rows reduced to
    each class at its highest probability, the top_k by probability, then name."""
    best = per_piece.groupBy("item_id", "start", "end", "name").agg(F.max("prob").alias("prob"))
    order = Window.partitionBy("item_id", "start", "end").orderBy(F.desc("prob"), "name")
    kept = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    row = F.struct("rank", "name", "prob")
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda e: F.struct(e["name"].alias("name"), e["prob"].alias("prob")))
    return kept.groupBy("item_id", "start", "end").agg(listed.alias("events"))


def merge_scenes(scenes: DataFrame, settings: SceneSettings = SceneSettings()) -> DataFrame:
    """Adjacent scenes of one kind within join_s become one; the longer part's label stays, the
    part merged so far winning a tie."""
    order = ["start", "end", "kind", "label"]
    kinds = bucketed_scan(scenes, ["item_id"], time_bucket("start"), order, [Scan("__prev", "lag", F.col("kind")), Scan("__n", "sum_before", F.lit(1))])
    kinds = settle(kinds.withColumn("__new", F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("kind")), F.col("__n"))))
    runs = bucketed_scan(kinds, ["item_id"], time_bucket("start"), order, [Scan("__from", "last_before", F.col("__new"))])
    runs = settle(runs.withColumn("__run", F.coalesce("__new", "__from")))
    keys = ["item_id", "__run"]
    reach = settle(bucketed_scan(runs, keys, time_bucket("start"), order, [Scan("__reach", "max_before", F.col("end"))]))
    opens = F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + settings.join_s)
    marked = reach.withColumn("__open", F.when(opens, F.struct("__n", "start")))
    placed = bucketed_scan(marked, keys, time_bucket("start"), order, [Scan("__earlier", "last_before", F.col("__open"))])
    # A part's label counts when it is longer than all that was merged before it; the last such
    # part names the scene, so no list of parts is ever held.
    merged_so_far = F.col("__reach") - F.col("__earlier.start")
    names = F.col("__open").isNotNull() | (F.col("end") - F.col("start") > merged_so_far)
    return (
        placed.withColumn("__group", F.coalesce("__open", "__earlier"))
        .groupBy("item_id", "__group")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind"),
            F.max(F.when(names, F.struct(*order, F.col("label").alias("named"))))["named"].alias("label"),
            F.max("probability").alias("probability"),
        )
        .drop("__group")
    )


def words_outside(words: DataFrame, scenes: DataFrame) -> DataFrame:
    """Words whose middle lies in no [start, end) scene."""
    return point_join(words, scenes, 0.5 * (F.col("start") + F.col("end")), ("start", "end"), how="left_anti")


def without_segments(segments: DataFrame, removed: DataFrame) -> DataFrame:
    return segments.join(removed.select("item_id", "start", "end", "text"), ["item_id", "start", "end", "text"], "left_anti").select(*segments.columns)


def seconds_by_kind(scenes: DataFrame) -> DataFrame:
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return scenes.groupBy("item_id", "kind").agg(F.sum(length).alias("seconds")).withColumn("place", place)


def regions(utterances: DataFrame, items: DataFrame, settings: SceneSettings = SceneSettings()) -> DataFrame:
    """What a tagger is asked about: gap windows and the utterances long enough (role)."""
    spans = utterances.select("item_id", "start", "end")
    windows = split_windows(gaps_between(spans, items, settings), settings.window_s)
    long = utterances.where(F.col("end") - F.col("start") >= settings.min_utterance_s)
    return windows.withColumns({"role": F.lit("gap"), "words": F.lit(0), "text": F.lit(None).cast("string")}).unionByName(
        long.select("item_id", "start", "end", F.lit("utterance").alias("role"), F.col("words").cast("int").alias("words"), "text")
    )


def analyse(
    samples: DataFrame, utterances: DataFrame, items: DataFrame, region_events: DataFrame | None = None,
    rate: int = 16000, settings: SceneSettings = SceneSettings(),
) -> tuple[DataFrame, DataFrame]:
    """(scenes, suppressed utterances). `utterances` carries `words`, the number of its words;
    `region_events` is (item_id, start, end, events) for every region, or None without a tagger:
    then only the level decides and nothing is set aside."""
    asked = settle(regions(utterances, items, settings))
    if region_events is None:
        tagged = asked.withColumn("events", F.lit(None).cast(EVENTS))
    else:
        missing = F.raise_error(F.format_string("no events for region %s [%s, %s)", F.col("item_id").cast("string"), "start", "end"))
        found = region_events.groupBy("item_id", "start", "end").agg(F.first("events").alias("events"))
        tagged = asked.join(found, ["item_id", "start", "end"], "left").withColumn("events", F.coalesce("events", missing.cast(EVENTS)))
    aside = should_suppress(F.col("events"), F.col("end") - F.col("start"), settings)
    judged = tagged.where((F.col("role") == "gap") | aside)
    levels = level_dbfs(samples, judged.select("item_id", "start", "end").distinct(), rate, settings.floor_dbfs)
    classed = settle(classify(judged.join(levels, ["item_id", "start", "end"]), settings))
    kind = F.when(F.col("role") == "utterance", F.coalesce("kind", F.lit("sound"))).otherwise(F.col("kind"))
    scenes = classed.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("item_id", "start", "end", "kind", "label", "probability")
    suppressed = classed.where((F.col("role") == "utterance") & (F.col("words") > 0)).select("item_id", "start", "end", "text", "words")
    return merge_scenes(scenes, settings), suppressed


def tag_regions(asked: DataFrame, tagger) -> DataFrame:
    """`region_events` from a caller's tagger: a function from a pandas frame of regions to one
    list of (name, prob) per region; a count that differs is an error."""

    def run(batches):
        for batch in batches:
            results = tagger(batch)
            if len(results) != len(batch):
                raise ValueError(f"the tagger returned {len(results)} results for {len(batch)} regions")
            batch = batch[["item_id", "start", "end"]].copy()
            batch["events"] = [[{"name": n, "prob": float(p)} for n, p in r] for r in results]
            yield batch

    kind = dict(asked.dtypes)["item_id"]
    return asked.select("item_id", "start", "end").mapInPandas(run, f"item_id {kind}, start double, end double, events {EVENTS}")
