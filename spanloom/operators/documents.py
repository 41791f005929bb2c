"""Transcript documents: assembled from flat tables, read back as flat tables, rendered to text.

A nested document is the exchange format and one row per recording; everything that computes
works on the flat tables (lines, marks, scenes, speakers), where a long recording is many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import REVIEW_SCHEMA, TRANSCRIPT_SCHEMA
from spanloom.functions import wording as wd
from spanloom.operators.counters import approximate_word_times
from spanloom.operators.cues import LISTENER, marked_text, transcript_entries
from spanloom.operators.intervals import overlap_join, union_seconds
from spanloom.operators.labels import UNLABELLED_NAME
from spanloom.operators.review import ratio
from spanloom.operators.scans import Scan, bucketed_scan, time_bucket
from spanloom.session import settle

WORD = "struct<s:double,e:double,w:string,src:string,mark:int>"
LINE = f"struct<start:double,end:double,speaker:string,text:string,src:string,split_from:int,words:array<{WORD}>>"
RESOLUTION = "struct<status:string,note:string,speaker:string>"
MARK = f"struct<start:double,end:double,span_start:double,span_end:double,detector_words:int,resolution:{RESOLUTION}>"
SCENE = "struct<start:double,end:double,kind:string,label:string,probability:double>"
SPEAKER = "struct<label:string,name:string,words:bigint,seconds:double>"
APPLIED = "struct<text:int,nothing:int,open:int,listener_words:int>"
PARTS = "array<struct<name:string,sha256:string,bytes:bigint,offset_s:double,duration_s:double>>"
ENGINE = "struct<engine:string,model:string,preset:string,word_timing:string>"
DIARIZATION = (
    "struct<engine:string,labels_found:int,settings:struct<num_speakers:int,threshold:double,labels_folded:int>,seconds_per_label:map<string,double>>"
)
NON_SPEECH = "struct<seconds_by_kind:map<string,double>,suppressed_publisher_words:bigint,suppressed_detector_words:bigint,tagged:boolean>"
# What a run tells of itself; documents without these columns are rendered as if they were null.
FACTS = {
    "version": "string", "engines": f"struct<publisher:{ENGINE},detector:{ENGINE},diarization:{DIARIZATION}>", "speaker_failure": "string",
    "non_speech": NON_SPEECH, "overview": "struct<scale:int,peaks:array<int>>",
}


def _document(source: str = "", applied: str = "", more: str = "") -> str:
    return (
        f"schema string, source struct<name:string,sha256:string,bytes:bigint,outputs:string,parts:{PARTS}{source}>, "
        f"duration_s double, produced_utc string, profile string, speakers array<{SPEAKER}>, lines array<{LINE}>, marks array<{MARK}>, "
        f"review struct<marks:int,seconds:double,fraction:double>, scenes array<{SCENE}>, review_applied {APPLIED[:-1]}{applied}>{more}"
    )


DOCUMENT = _document()
FULL_DOCUMENT = _document(",video:boolean", ",applied_utc:string", "".join(f", {c} {t}" for c, t in FACTS.items()))
OVERVIEW_SCALE = 100


def _listed(df: DataFrame, order: list[str], fields: dict[str, Column], type_: str, name: str) -> DataFrame:
    """One array of structs per item, in order."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[v.alias(k) for k, v in fields.items()]).cast(type_).alias("v"))
    return df.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias(name))


def build_document(facts: DataFrame, lines: DataFrame, marks: DataFrame, scenes: DataFrame, speakers: DataFrame) -> DataFrame:
    """One nested document per item. `facts` has (item_id, name, sha256, bytes, audio_s, profile,
    produced_utc) and, where they are known, parts, output_base, video and the columns of FACTS;
    an overview may come as its array of peaks. `speakers` is `named_speakers` of the lines."""
    null = lambda t: F.lit(None).cast(t)
    src = F.col("src") if "src" in lines.columns else null("string")
    line = {"start": F.col("start"), "end": F.col("end"), "speaker": F.col("speaker"), "text": F.col("text"), "src": src, "split_from": null("int"), "words": F.col("words")}
    mark = {c: F.col(c) for c in ("start", "end", "span_start", "span_end", "detector_words")} | {"resolution": null(RESOLUTION)}
    scene = {c: F.col(c) for c in ("start", "end", "kind", "label", "probability")}
    speaker = {"label": F.col("speaker"), "name": F.col("name"), "words": F.col("words"), "seconds": F.col("seconds")}
    doc = facts
    for part in (
        _listed(lines, ["start", "end"], line, LINE, "lines"),
        _listed(marks, ["mark"], mark, MARK, "marks"),
        _listed(scenes, ["start", "end"], scene, SCENE, "scenes"),
        _listed(speakers, ["place"], speaker, SPEAKER, "speakers"),
        union_seconds(marks).withColumnRenamed("seconds", "__review_s"),
    ):
        doc = doc.join(part, "item_id", "left")
    empty = {n: F.coalesce(n, F.array().cast(f"array<{t}>")) for n, t in (("lines", LINE), ("marks", MARK), ("scenes", SCENE), ("speakers", SPEAKER))}
    seconds = F.coalesce("__review_s", F.lit(0.0))
    doc = doc.withColumns(empty)
    given = lambda c, t: F.col(c).cast(t) if c in facts.columns else null(t)
    outputs = F.coalesce(F.nullif(given("output_base", "string"), F.lit("")), wd.stem("name"))
    known = {c: given(c, t) for c, t in FACTS.items() if c != "overview"}
    if dict(facts.dtypes).get("overview", "").startswith("array"):
        known["overview"] = F.struct(F.lit(OVERVIEW_SCALE).alias("scale"), F.col("overview").cast("array<int>").alias("peaks"))
    else:
        known["overview"] = given("overview", FACTS["overview"])
    known["non_speech"] = F.coalesce(known["non_speech"], _no_non_speech())
    return doc.select(
        "item_id", F.lit(TRANSCRIPT_SCHEMA).alias("schema"),
        F.struct("name", "sha256", F.col("bytes").cast("bigint").alias("bytes"), outputs.alias("outputs"), given("parts", PARTS).alias("parts"), F.coalesce(given("video", "boolean"), F.lit(False)).alias("video")).alias("source"),
        F.col("audio_s").alias("duration_s"), "produced_utc", "profile", "speakers", "lines", "marks",
        F.struct(F.size("marks").alias("marks"), seconds.alias("seconds"), ratio(seconds, F.col("audio_s")).alias("fraction")).alias("review"),
        "scenes", null(f"{APPLIED[:-1]},applied_utc:string>").alias("review_applied"), *[c.alias(n) for n, c in known.items()],
    )


def _no_non_speech() -> Column:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    zero = F.lit(0).cast("bigint")
    return F.struct(
        none.alias("seconds_by_kind"), zero.alias("suppressed_publisher_words"), zero.alias("suppressed_detector_words"), F.lit(False).alias("tagged")
    ).cast(NON_SPEECH)


def with_non_speech(facts: DataFrame, totals: DataFrame) -> DataFrame:
    """`facts` with non_speech from `counters.non_speech_totals`."""
    fields = ("seconds_by_kind", "suppressed_publisher_words", "suppressed_detector_words", "tagged")
    return facts.join(totals.select("item_id", F.struct(*fields).cast(NON_SPEECH).alias("non_speech")), "item_id", "left")


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("item_id", F.posexplode("lines").alias("line", "l")).select("item_id", "line", "l.*")


def marks_of(docs: DataFrame) -> DataFrame:
    return docs.select("item_id", F.posexplode("marks").alias("mark", "m")).select("item_id", "mark", "m.*")


def scenes_of(docs: DataFrame) -> DataFrame:
    return docs.select("item_id", F.explode("scenes").alias("s")).select("item_id", "s.*")


def speakers_of(docs: DataFrame) -> DataFrame:
    named = docs.select("item_id", F.posexplode("speakers").alias("place", "s")).select("item_id", "place", "s.*")
    return named.withColumnRenamed("label", "speaker")


def speaker_names(docs: DataFrame) -> DataFrame:
    """(item_id, speaker, name): the display name, the label itself where none was given."""
    return speakers_of(docs).where(F.col("speaker").isNotNull()).select("item_id", "speaker", F.coalesce(F.when(F.col("name") != "", F.col("name")), "speaker").alias("name"))


def document_facts(docs: DataFrame) -> DataFrame:
    """Name, size, parts, duration, labelled speakers and marks of each document."""
    parts = F.coalesce("source.parts", F.array().cast("array<struct<name:string,sha256:string,bytes:bigint,offset_s:double,duration_s:double>>"))
    return docs.select(
        "item_id", "source.name", "source.bytes", F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["bytes"].alias("bytes"))).alias("parts"),
        "duration_s", F.size(F.filter("speakers", lambda s: s["label"].isNotNull())).alias("speakers"), F.col("review.marks").alias("marks"),
    )


def document_is_for(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of document facts and files (name, bytes) of the same name and, when both are known,
    the same size; a document in parts carries the size of its first part."""
    expected = F.coalesce(F.try_element_at("parts", F.lit(1))["bytes"], F.col("bytes"))
    facts = facts.withColumn("__bytes", F.coalesce(expected, F.lit(0)))
    f = files.select("folder", "name", F.col("bytes").alias("__bytes"))
    # Where both sizes are known they are part of the key: a name that many files share stays small.
    sized = facts.where(F.col("__bytes") != 0).join(f.where(F.col("__bytes").isNotNull()), ["name", "__bytes"])
    unsized = facts.where(F.col("__bytes") == 0).join(f.drop("__bytes"), "name")
    unknown = facts.where(F.col("__bytes") != 0).join(f.where(F.col("__bytes").isNull()).drop("__bytes"), "name")
    columns = [c for c in facts.columns if c != "__bytes"] + ["folder"]
    return sized.select(*columns).unionByName(unsized.select(*columns)).unionByName(unknown.select(*columns))


def recount(docs: DataFrame) -> DataFrame:
    """`speakers` counted again from the lines: entries keep order and names, labels only the
    lines carry are appended without a name."""
    counted = F.transform(
        F.filter("lines", lambda l: F.lit(True)),
        lambda l: F.struct(l["speaker"].alias("label"), F.size(l["words"]).cast("bigint").alias("words"), F.greatest(l["end"] - l["start"], F.lit(0.0)).alias("seconds")),
    )

    def total(label: Column, field: str, zero: Column) -> Column:
        mine = F.filter(F.col("__counted"), lambda c: c["label"].eqNullSafe(label))
        return F.aggregate(mine, zero, lambda a, c: a + c[field])

    def entry(label: Column, name: Column) -> Column:
        return F.struct(label.alias("label"), name.alias("name"), total(label, "words", F.lit(0).cast("bigint")).alias("words"), total(label, "seconds", F.lit(0.0)).alias("seconds"))

    kept = F.transform("speakers", lambda s: entry(s["label"], s["name"]))
    known = F.transform("speakers", lambda s: s["label"])
    fresh = F.filter(F.array_distinct(F.transform("__counted", lambda c: c["label"])), lambda l: ~F.exists(known, lambda k: k.eqNullSafe(l)))
    added = F.transform(fresh, lambda l: entry(l, F.lit(None).cast("string")))
    return docs.withColumn("__counted", counted).withColumn("speakers", F.concat(kept, added)).drop("__counted")


def set_speaker_name(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Rename speakers by (item_id, label, name); an empty name or an unknown label is an error."""
    clean = F.trim(F.regexp_replace("name", r"(?U)\s+", " "))
    checked = names.withColumn("name", F.when(clean == "", F.raise_error(F.lit("a speaker name must not be empty"))).otherwise(clean))
    mapped = checked.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "name"))).alias("__names"))
    joined = docs.join(mapped, "item_id", "left")
    unknown = F.exists(F.map_keys("__names"), lambda n: ~F.exists("speakers", lambda s: s["label"] == n))
    renamed = F.transform("speakers", lambda s: s.withField("name", F.coalesce(F.try_element_at("__names", s["label"]), s["name"])))
    bad = F.raise_error(F.lit("no speaker with that label")).cast(f"array<{SPEAKER}>")
    return joined.withColumn("speakers", F.when(F.col("__names").isNull(), F.col("speakers")).when(unknown, bad).otherwise(renamed)).drop("__names")


def merge_speakers(docs: DataFrame, label: str, into: str) -> DataFrame:
    """Lines of `label` given to `into`, its entry removed, counts made again; documents that do
    not carry both labels are an error."""
    if label == into:
        raise ValueError("a speaker cannot be merged into itself")
    has = lambda x: F.exists("speakers", lambda s: s["label"] == x)
    bad = F.raise_error(F.format_string("no speaker labelled %s or %s", F.lit(label), F.lit(into))).cast(f"array<{LINE}>")
    moved = F.transform("lines", lambda l: l.withField("speaker", F.when(l["speaker"] == label, F.lit(into)).otherwise(l["speaker"])))
    out = docs.withColumn("lines", F.when(has(label) & has(into), moved).otherwise(bad))
    return recount(out.withColumn("speakers", F.filter("speakers", lambda s: ~(F.coalesce(s["label"] == label, F.lit(False))))))


def review_set(published: DataFrame, marks: DataFrame, items: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Review documents: transcript words and marks, with the reference's word count and speakers
    (in order of first appearance) per mark when a reference is given."""
    words = _listed(published, ["start", "end", "seq"], {"s": F.col("start"), "e": F.col("end"), "w": F.col("text")}, "struct<s:double,e:double,w:string>", "transcript")
    counted = marks.withColumns({"reference_words": F.lit(None).cast("bigint"), "reference_speakers": F.lit(None).cast("array<string>")})
    if reference is not None:
        counted = marks_with_reference(marks, reference)
    fields = {c: F.col(c) for c in ("start", "end", "span_start", "span_end", "detector_words", "detector_text", "reference_words", "reference_speakers")}
    type_ = (
        "struct<start:double,end:double,span_start:double,span_end:double,detector_words:int,detector_text:string,"
        "reference_words:bigint,reference_speakers:array<string>>"
    )
    listed = _listed(counted, ["mark"], fields, type_, "marks")
    joined = items.join(words, "item_id", "left").join(listed, "item_id", "left")
    return joined.select(
        "item_id", F.lit(REVIEW_SCHEMA).alias("schema"), F.col("audio_s").alias("duration_s"),
        F.coalesce("transcript", F.array().cast("array<struct<s:double,e:double,w:string>>")).alias("transcript"),
        F.coalesce("marks", F.array().cast(f"array<{type_}>")).alias("marks"),
    )


def marks_with_reference(marks: DataFrame, reference: DataFrame) -> DataFrame:
    probe = reference.select("item_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("speaker").alias("r_speaker"))
    pairs = overlap_join(marks.select("item_id", "mark", "span_start", "span_end"), probe, left_span=("span_start", "span_end"))
    firsts = pairs.groupBy("item_id", "mark", "r_speaker").agg(F.count("*").alias("n"), F.min(F.struct("r_start", "r_end")).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "r_speaker"))), lambda x: x["r_speaker"])
    found = firsts.groupBy("item_id", "mark").agg(F.sum("n").alias("reference_words"), ordered.alias("reference_speakers"))
    return marks.join(found, ["item_id", "mark"], "left").withColumns(
        {"reference_words": F.coalesce("reference_words", F.lit(0).cast("bigint")), "reference_speakers": F.coalesce("reference_speakers", F.array().cast("array<string>"))}
    )


def gap_context(marks: DataFrame, words: DataFrame, names: DataFrame | None = None, each_side: int = 14) -> DataFrame:
    """(item_id, mark, context): up to each_side words before and after every gap around
    `[ GAP ]`, `...` where words were cut; with names, the speaker's name at each change.
    `words` carries (item_id, seq, start, end, text[, label])."""
    label = F.col("label") if names is not None else F.lit(None).cast("string")
    rows = words.select("item_id", F.col("start").alias("t"), F.lit(1).alias("flag"), "seq", "text", label.alias("label"))
    asks = marks.select("item_id", F.col("span_start").alias("t"), F.lit(0).alias("flag"), "mark")
    both = rows.unionByName(asks, allowMissingColumns=True)
    at = Scan("at", "sum_before", F.when(F.col("flag") == 1, 1).otherwise(0))
    # Read as words and as gaps by the join below.
    placed = settle(bucketed_scan(both, ["item_id"], time_bucket("t"), ["t", "flag", "seq"], [at]))
    near = F.explode(F.sequence(F.greatest(F.col("at") - each_side - 1, F.lit(0)), F.col("at") + each_side))
    wanted = placed.where("flag = 0").select("item_id", "mark", F.col("at").alias("from"), near.alias("at"))
    found = wanted.join(placed.where("flag = 1").select("item_id", "at", "text", "label"), ["item_id", "at"])
    if names is not None:
        found = found.join(names.select("item_id", F.col("speaker").alias("label"), "name"), ["item_id", "label"], "left")
        shown = F.when(F.col("label").isNull(), F.lit(UNLABELLED_NAME)).otherwise(F.coalesce("name", "label"))
    else:
        shown = F.lit(None).cast("string")
    piece = F.struct("at", "text", "label", F.concat(shown, F.lit(":")).alias("name"))
    listed = F.array_sort(F.collect_list(piece))
    grouped = found.groupBy("item_id", "mark").agg(listed.alias("w"), F.first("from").alias("from"))

    def said(side: Column) -> Column:
        if names is None:
            return F.transform(side, lambda w: w["text"])
        before = F.concat(F.array(F.lit(None).cast("struct<at:bigint,text:string,label:string,name:string>")), side)
        changed = lambda w, i: (i == 0) | ~F.get(before, i)["label"].eqNullSafe(w["label"])
        return F.flatten(F.transform(side, lambda w, i: F.when(changed(w, i), F.array(w["name"], w["text"])).otherwise(F.array(w["text"]))))

    left = F.filter("w", lambda w: (w["at"] < F.col("from")) & (w["at"] >= F.col("from") - each_side))
    right = F.filter("w", lambda w: (w["at"] >= F.col("from")) & (w["at"] < F.col("from") + each_side))
    dots = lambda yes: F.when(yes, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(
        F.concat(
            dots(F.col("from") > each_side), said(left), F.array(F.lit("[ GAP ]")), said(right),
            dots(F.exists("w", lambda w: w["at"] >= F.col("from") + each_side)),
        ),
        " ",
    )
    contexts = grouped.select("item_id", "mark", text.alias("context"))
    return marks.select("item_id", "mark").join(contexts, ["item_id", "mark"], "left").withColumn("context", F.coalesce("context", F.lit("[ GAP ]")))


def transcript_lines(docs: DataFrame) -> DataFrame:
    """Text rows (item_id, at, value): one per line or scene, a blank row before a change of
    speaker and around scenes."""
    lines = lines_of(docs).withColumn("text", marked_text(F.col("words"), F.col("text"), F.col("src")))
    entries = transcript_entries(lines, scenes_of(docs)).join(
        speaker_names(docs).select("item_id", F.col("speaker").alias("label"), "name"), ["item_id", "label"], "left"
    )
    name = F.when(F.col("label").isNull(), F.lit(UNLABELLED_NAME)).otherwise(F.coalesce("name", "label"))
    said = F.concat(F.lit("["), wd.clock("start"), F.lit("] "), name, F.lit(": "), F.col("text"))
    heard = F.concat(F.lit("["), wd.clock("start"), F.lit("] ("), F.col("text"), F.lit(")"))
    shown = entries.withColumn("value", F.when(F.col("entry") == "scene", heard).otherwise(said))
    stepped = bucketed_scan(
        shown, ["item_id"], time_bucket("start"), ["start", "rank", "end", "value"],
        [Scan("prev", "lag", F.struct("entry", "label")), Scan("at", "sum_before", F.lit(1))],
    )
    changed = (F.col("entry") == "scene") | (F.col("prev.entry") == "scene") | ~F.col("prev.label").eqNullSafe(F.col("label"))
    values = F.when(F.col("prev").isNotNull() & changed, F.array(F.lit(""), F.col("value"))).otherwise(F.array("value"))
    rows = stepped.select("item_id", "at", F.posexplode(values).alias("sub", "value"))
    return rows.select("item_id", (F.col("at") * 2 + F.col("sub")).alias("at"), "value")


def set_aside_note(published: Column, detector: Column) -> Column:
    """One sentence on words set aside in non-speech scenes, NULL when there are none."""
    def part(n: Column, what: str, why: str) -> Column:
        return F.when(n > 0, F.format_string(f"%d %s the {what} %s {why}", n, wd.plural(n, "word", "words"), wd.plural(n, "was", "were")))

    first = part(published, "published engine wrote inside music or noise", "set aside (listed in the run record)")
    second = part(detector, "second engine placed inside silence, music or noise", "left out of the review list")
    text = F.concat(F.lit("Set aside: "), F.concat_ws("; ", first, second), F.lit("."))
    return F.when((published > 0) | (detector > 0), text)


def engine_line(facts: Column) -> Column:
    """An engine and its model, with the preset behind; none without facts."""
    name = F.concat_ws(" ", F.nullif(facts["engine"], F.lit("")), F.nullif(facts["model"], F.lit("")))
    return F.when(facts.isNull(), F.lit("none")).when(F.coalesce(facts["preset"], F.lit("")) != "", F.concat(name, F.lit(" ("), facts["preset"], F.lit(")"))).otherwise(name)


def label_line(facts: Column) -> Column:
    """The engine that told the speakers apart and how it was set; NULL without one."""
    settings = facts["settings"]
    count, threshold, folded = settings["num_speakers"], settings["threshold"], settings["labels_folded"]
    fixed = F.format_string(", speaker count fixed at %d (a speaker the models cannot separate is then hidden inside another label)", count)
    small = F.when(folded > 0, F.format_string(", %d small %s folded into the nearest voice", folded, wd.plural(folded, "label", "labels"))).otherwise("")
    detail = F.when(count > 0, fixed).when(threshold.isNotNull(), F.concat(F.lit(", clustering threshold "), wd.general(threshold), small)).otherwise("")
    return F.when(facts.isNotNull(), F.concat(F.lit("Speaker labels: "), F.coalesce(facts["engine"], F.lit("")), detail))


APPROXIMATE_NOTE = "; its word times are approximate, so the review list may miss short gaps"


def header_rows(docs: DataFrame) -> DataFrame:
    """Header rows of the text rendering (item_id, at, value)."""
    docs = docs.withColumns({c: F.lit(None).cast(t) for c, t in FACTS.items() if c not in docs.columns})
    engines, aside = F.col("engines"), F.col("non_speech")
    approximate = approximate_word_times(F.to_json(engines["detector"]))
    checked_by = F.concat(
        F.lit("Checked against: "), engine_line(engines["detector"]), F.lit("; its text is never published"), F.when(approximate, F.lit(APPROXIMATE_NOTE)).otherwise("")
    )
    told = F.concat(F.lit("Speaker labelling did not complete: "), F.nullif("speaker_failure", F.lit("")))
    labelled = F.size(F.filter("speakers", lambda s: s["label"].isNotNull()))
    marks, stem = F.col("review.marks"), F.coalesce("source.outputs", wd.stem("source.name"))
    spans = wd.plural(marks, "span", "spans")
    a = F.col("review_applied")
    checked = wd.all_checked(a["text"], a["nothing"], a["open"])
    speaker_rows = F.transform(
        "speakers",
        lambda s: F.format_string(
            "  %-24s %7s %-5s %s",
            F.when(s["label"].isNull(), F.lit(UNLABELLED_NAME)).otherwise(F.coalesce(s["name"], s["label"])),
            F.format_number(s["words"], 0), wd.plural(s["words"], "word", "words"), wd.clock(s["seconds"]),
        ),
    )
    review = (
        F.when((marks > 0) & checked, F.format_string("Review list: %d %s where speech may have been missing, every one checked by a listener; see %s.review.json.", marks, spans, stem))
        .when(marks > 0, F.format_string("Review list: %d %s where speech may be missing, %.1f%% of the recording; see %s.review.json.", marks, spans, 100.0 * F.col("review.fraction"), stem))
        .otherwise("Review list: no span where speech may be missing was found.")
    )
    by_kind = F.filter(
        F.transform(
            F.array(*[F.lit(k) for k in wd.SCENE_NOUNS]),
            lambda k: F.struct(
                k.alias("kind"),
                F.aggregate(F.filter("scenes", lambda s: s["kind"] == k), F.lit(0.0), lambda t, s: t + F.greatest(s["end"] - s["start"], F.lit(0.0))).alias("s"),
            ),
        ),
        lambda x: x["s"] > 0,
    )
    quiet = F.array_join(F.transform(by_kind, lambda x: F.concat(wd.scene_noun(x["kind"], F.lit("")), F.lit(" "), wd.format_seconds(x["s"]))), ", ")
    version = F.coalesce(F.concat(F.lit("version "), F.nullif("version", F.lit("")), F.lit(", ")), F.lit(""))
    facts = F.format_string(
        "Duration %s   |   %d %s   |   produced %s   |   %squality level %s",
        wd.clock("duration_s", tenths=False), labelled, wd.plural(labelled, "speaker", "speakers"), "produced_utc", version, "profile",
    )
    none = F.when(F.size("speakers") == 0, F.array(F.lit("  (no words were published)"))).otherwise(F.array().cast("array<string>"))
    rows = F.concat(
        F.array(
            F.col("source.name"), facts, F.concat(F.lit("Published engine: "), engine_line(engines["publisher"])), checked_by,
            label_line(engines["diarization"]), told, F.lit(""), F.lit("Speakers"),
        ),
        speaker_rows, none,
        F.array(
            F.lit(""), review, wd.reviewed_note(a["text"], a["nothing"], a["open"], "in braces"),
            F.when(quiet != "", F.concat(F.lit("Without speech: "), quiet, F.lit("; marked in the transcript."))),
            set_aside_note(F.coalesce(aside["suppressed_publisher_words"], F.lit(0)), F.coalesce(aside["suppressed_detector_words"], F.lit(0))),
            F.lit("A transcript is a draft until it has been verified against the recording."), F.lit(""), F.lit("Transcript"), F.lit(""),
        ),
    )
    return docs.select("item_id", F.posexplode(F.filter(rows, lambda v: v.isNotNull())).alias("at", "value"))


def text_rows(docs: DataFrame) -> DataFrame:
    """The whole text rendering as ordered rows (item_id, section, at, value)."""
    head = header_rows(docs).select("item_id", F.lit(0).alias("section"), F.col("at").cast("bigint").alias("at"), "value")
    body = transcript_lines(docs).select("item_id", F.lit(1).alias("section"), "at", "value")
    return head.unionByName(body)
