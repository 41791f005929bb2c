"""Files, parts, output names, store verification, history, outcomes: the bookkeeping tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import wording as wd
from spanloom.session import settle
from spanloom.operators.scans import Scan, bucketed_scan
from spanloom.sources.digests import chain_digests

# ---- fixed values ---------------------------------------------------------------------------
AUDIO_EXTENSIONS = (
    ".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".oga", ".opus", ".wma", ".aiff", ".aif", ".amr", ".mp2", ".wv", ".ape",
)
VIDEO_EXTENSIONS = (
    ".mp4", ".m4v", ".mov", ".avi", ".mkv", ".wmv", ".webm", ".mpg", ".mpeg", ".3gp", ".ts", ".mts", ".m2ts", ".flv", ".asf",
    ".vob", ".trm",
)
JOIN_TOLERANCE_S = 2.0
MAX_JOIN_GAP_S = 900.0
ITEM_KINDS = ("hvb-call", "ami-meeting", "librispeech-utterance")
CALL_TRANSCRIPT = "transcript.json"
# ----------------------------------------------------------------------------------------------


def is_media(name: Column | str) -> Column:
    return wd.extension(name).isin(*AUDIO_EXTENSIONS, *VIDEO_EXTENSIONS)


def is_video(name: Column | str) -> Column:
    return wd.extension(name).isin(*VIDEO_EXTENSIONS)


def discover_media(files: DataFrame) -> DataFrame:
    """Media files of an inventory (folder, name, ...), one per resolved path, sorted. Of several
    spellings of a path the first by folder and name stays."""
    path = F.lower(wd.canonical_path(F.concat_ws("/", "folder", "name")))
    media = files.where(is_media("name")).withColumn("path_key", path)
    first = media.groupBy("path_key").agg(F.min_by(F.struct(*files.columns), F.struct("folder", "name")).alias("first"))
    unique = first.select("first.*", "path_key")
    return unique.orderBy(F.lower("folder"), F.lower("name"))


def unread_types(files: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent extensions that are not read; '' for none."""
    ext = wd.extension("name")
    return files.where(~is_media("name")).groupBy(ext.alias("ext")).count().orderBy(F.desc("count"), "ext").limit(limit)


def group_parts(files: DataFrame, bucket_s: float = 86400.0) -> DataFrame:
    """`files` (folder, name, start_utc, duration_s) with chain (the first file's name), part (from
    0) and offset_s. Timed files of one folder and extension chain while each starts where the
    previous one ended, up to 2 s early or 900 s late; an untimed file stands alone."""
    timed = F.col("start_utc").isNotNull() & F.col("duration_s").isNotNull()
    rows = files.withColumns({"ext": wd.extension("name"), "us": F.unix_micros(F.col("start_utc").cast("timestamp"))})
    keys = ["folder", "ext"]
    bucket = F.floor(F.col("us") / F.lit(bucket_s * 1e6)).cast("bigint")
    order = ["us", "name"]
    stepped = bucketed_scan(
        rows.where(timed), keys, bucket, order, [Scan("prev", "lag", F.struct("us", "duration_s")), Scan("n", "sum_before", F.lit(1))]
    )
    gap = (F.col("us") - F.col("prev.us")) / F.lit(1e6) - F.col("prev.duration_s")
    joins = F.coalesce((gap >= -JOIN_TOLERANCE_S) & (gap <= MAX_JOIN_GAP_S), F.lit(False))
    head = F.struct("n", "us", "name")
    # Read twice by the scan below.
    marked = settle(stepped.withColumn("head", F.when(~joins, head)).drop("prev"))
    placed = bucketed_scan(marked, keys, bucket, order, [Scan("earlier", "last_before", F.col("head"))])
    first = F.coalesce("head", "earlier")
    chained = placed.withColumn("first", first).select(
        *files.columns, F.col("first.name").alias("chain"), (F.col("n") - F.col("first.n")).alias("part"),
        ((F.col("us") - F.col("first.us")) / F.lit(1e6)).alias("offset_s"),
    )
    alone = rows.where(~timed).select(*files.columns, F.col("name").alias("chain"), F.lit(0).cast("bigint").alias("part"), F.lit(0.0).alias("offset_s"))
    return chained.unionByName(alone)


def recordings(parts: DataFrame) -> DataFrame:
    """One row per recording with its parts; more than one only for a chain."""
    row = F.struct("part", "name", "offset_s", "duration_s")
    return parts.groupBy("folder", "chain").agg(F.count("*").alias("n_parts"), F.array_sort(F.collect_list(row)).alias("parts"))


def place_parts(parts: DataFrame) -> DataFrame:
    """Where each part lies in the joined recording: cut at the next part's start."""
    stepped = bucketed_scan(parts, ["folder", "chain"], F.floor(F.col("part") / 4096), ["part"], [Scan("next", "lead", F.col("offset_s"))])
    end = F.col("offset_s") + F.col("duration_s")
    return stepped.select(*parts.columns, F.when(F.col("next").isNull(), end).otherwise(F.least(end, F.col("next"))).alias("end_s"))


def parts_digest(parts: DataFrame) -> DataFrame:
    """(folder, chain, sha256, bytes): the digest of the joined hex digests in part order."""
    return chain_digests(parts, ["folder", "chain"], ["part"])


def output_base(files: DataFrame) -> DataFrame:
    """`files` with base: the stem, or the whole name beside a file of the same stem."""
    keyed = files.withColumn("__stem", F.lower(wd.stem("name")))
    stems = keyed.groupBy("folder", "__stem").agg((F.min(F.lower("name")) != F.max(F.lower("name"))).alias("__shared"))
    base = F.when(F.col("__shared"), F.col("name")).otherwise(wd.stem("name"))
    return keyed.join(stems, ["folder", "__stem"]).withColumn("base", base).drop("__stem", "__shared")


def claim_witnesses(claims: DataFrame) -> DataFrame:
    """Of `claims` (name, recorded) at most 36 a name, such that a path differs from one of the
    name's recordings just when it differs from one of these. Paths of one class (absolute or not; no,
    one or more steps) are told apart by one of three texts, whichever the other path is; if any
    recording's text differs from the other path's, so does the least or the greatest."""
    recorded = F.col("recorded")
    texts = [wd.canonical_path(recorded), wd.last_parts(recorded, F.lit(2)), wd.last_parts(recorded, F.lit(1))]
    steps = F.size(F.filter(F.split(recorded, "/"), lambda x: (x != "") & (x != ".")))
    rows = claims.where(recorded.isNotNull()).select(
        "name", "recorded", F.startswith(recorded, F.lit("/")).alias("__abs"), F.least(steps, F.lit(2)).alias("__steps"), *[t.alias(f"__t{i}") for i, t in enumerate(texts)]
    )
    ends = [pick(recorded, F.col(f"__t{i}")) for i in range(len(texts)) for pick in (F.min_by, F.max_by)]
    found = rows.groupBy("name", "__abs", "__steps").agg(F.array_distinct(F.array(*ends)).alias("__ends"))
    return found.select("name", F.explode("__ends").alias("recorded"))


def output_paths(files: DataFrame, claims: DataFrame) -> DataFrame:
    """`files` (path, parent, base) with output: base, or, where `claims` (base, recorded) gives a
    name to another recording, parent-base, then base with a short digest of the path. Claims without a
    recording claim nothing; however many there are of a name, a file meets a bounded number."""
    digest = F.substring(F.sha1(F.lower(wd.canonical_path("path")).cast("binary")), 1, 8)
    options = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("base").alias("name")),
        F.struct(F.lit(1).alias("rank"), F.when(F.col("parent") != "", F.concat("parent", F.lit("-"), "base")).alias("name")),
        F.struct(F.lit(2).alias("rank"), F.concat("base", F.lit("-"), digest).alias("name")),
    )
    each = files.select("path", F.explode(options).alias("o")).select("path", "o.*").where(F.col("name").isNotNull())
    taken = each.join(claim_witnesses(claims.select(F.col("base").alias("name"), "recorded")), "name", "left")
    theirs = F.col("recorded").isNotNull() & ~wd.same_recording("recorded", "path")
    free = taken.groupBy("path", "rank", "name").agg(F.bool_or(theirs).alias("claimed"))
    chosen = free.groupBy("path").agg(
        F.min(F.when(~F.col("claimed"), F.struct("rank", "name"))).alias("best"), F.min(F.when(F.col("rank") == 0, F.col("name"))).alias("base_name")
    )
    return files.join(chosen.select("path", F.coalesce("best.name", "base_name").alias("output")), "path")


def verify_store(required: DataFrame, present: DataFrame, lock: DataFrame) -> DataFrame:
    """(key, file, status, detail) for every required file; present and lock carry sha256."""
    have = present.select("key", "file", F.col("sha256").alias("have"), F.lit(True).alias("here"))
    pinned = lock.select("key", "file", F.col("sha256").alias("pin"), F.lit(True).alias("locked"))
    joined = required.select("key", "file").join(have, ["key", "file"], "left").join(pinned, ["key", "file"], "left")
    status = (
        F.when(F.col("here").isNull(), "missing").when(F.col("locked").isNull(), "unpinned").when(F.col("have") == F.col("pin"), "verified").otherwise("mismatch")
    )
    short = lambda c: F.substring(c, 1, 16)
    detail = (
        F.when(F.col("status") == "missing", F.concat(F.lit("expected "), "key", F.lit("/"), "file"))
        .when(F.col("status") == "unpinned", "present, no digest recorded")
        .when(F.col("status") == "verified", short("have"))
        .otherwise(F.concat(F.lit("have "), short("have"), F.lit(", lock "), short(F.coalesce("pin", F.lit("None")))))
    )
    return joined.withColumn("status", status).withColumn("detail", detail).select("key", "file", "status", "detail")


def files_to_check(present: DataFrame, lock: DataFrame) -> DataFrame:
    """Files of a selection: everything pinned or present."""
    return lock.select("key", "file").union(present.select("key", "file")).distinct()


def missing_files(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.select("key", "file").join(present, ["key", "file"], "left_anti")


def corpora(required: DataFrame, present: DataFrame) -> DataFrame:
    """Corpora with some file present, complete or with the files they lack."""
    lacking = missing_files(required, present).groupBy("key").agg(F.count("*").alias("missing"))
    return present.join(required.select("key").distinct(), "key", "left_semi").select("key").distinct().join(lacking, "key", "left").select(
        "key", F.col("missing").isNull().alias("complete"), F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing")
    )


def chapter_selection(names: DataFrame, prefix: str, chapters: int, per_chapter: int, folder: str = "utterances") -> DataFrame:
    """(member, target): the first per_chapter utterances of the first chapters, and each chapter's
    transcript; `names` has a name column of archive members."""
    from pyspark.sql import Window

    flac = names.where(F.startswith("name", F.lit(prefix)) & F.endswith("name", F.lit(".flac"))).withColumn("chapter", F.regexp_extract("name", r"^(.*)/[^/]*$", 1))
    wanted = flac.select("chapter").distinct().orderBy("chapter").limit(chapters)
    rank = F.row_number().over(Window.partitionBy("chapter").orderBy("name"))
    files = flac.join(wanted, "chapter").withColumn("rank", rank).where(F.col("rank") <= per_chapter)
    ids = F.slice(F.split("chapter", "/"), -2, 2)
    trans = F.concat(F.array_join(ids, "-"), F.lit(".trans.txt"))
    audio = files.select(F.col("name").alias("member"), F.concat(F.lit(folder + "/"), wd.file_name("name")).alias("target"))
    text = wanted.select(F.concat("chapter", F.lit("/"), trans).alias("member"), F.concat(F.lit(folder + "/"), trans).alias("target"))
    return audio.unionByName(text)


def list_items(present: DataFrame, calls: DataFrame, meetings: DataFrame, utterances: DataFrame) -> DataFrame:
    """(section, place, item_id, corpus, kind, source, window_start, window_end) of every item that a
    store can build; by section, place and item_id they are in their fixed order. `present` (key, file)
    lists the store. `calls` (key, prefix, call, place) are items whose transcript is there. `meetings`
    (key, prefix, meeting, microphone, source, place, window_start, window_end) are two items each, first
    all windows, then all whole meetings, where the store has the corpus at all. `utterances` (key,
    prefix, folder) makes an item of every .flac file that lies in the folder itself."""
    call, meeting, utterance = map(F.lit, ITEM_KINDS)
    none = F.lit(None).cast("double")
    transcript = calls.withColumn("file", F.concat(F.lit("calls/"), "call", F.lit("/" + CALL_TRANSCRIPT)))
    spoken = transcript.join(present, ["key", "file"], "left_semi").select(
        F.lit(0).alias("section"), F.col("place").cast("bigint").alias("place"), F.concat("prefix", F.lit("/"), "call").alias("item_id"),
        F.col("key").alias("corpus"), call.alias("kind"), F.col("call").alias("source"), none.alias("window_start"), none.alias("window_end"),
    )
    tag = F.format_string("%d-%d", F.col("window_start").cast("bigint"), F.col("window_end").cast("bigint"))
    uses = F.array(
        F.struct(F.lit(1).alias("section"), tag.alias("tag"), F.col("window_start").cast("double").alias("from"), F.col("window_end").cast("double").alias("to")),
        F.struct(F.lit(2).alias("section"), F.lit("full").alias("tag"), none.alias("from"), none.alias("to")),
    )
    met = meetings.join(present, "key", "left_semi").withColumn("use", F.explode(uses)).select(
        "use.section", F.col("place").cast("bigint").alias("place"), F.concat_ws("/", "prefix", "meeting", "microphone", "use.tag").alias("item_id"),
        F.col("key").alias("corpus"), meeting.alias("kind"), "source", F.col("use.from").alias("window_start"), F.col("use.to").alias("window_end"),
    )
    name = wd.file_name("file")
    inside = F.col("file") == F.concat("folder", F.lit("/"), name)
    said = present.select("key", "file").distinct().join(utterances, "key").where(inside & F.endswith("file", F.lit(".flac"))).select(
        F.lit(3).alias("section"), F.lit(None).cast("bigint").alias("place"), F.concat("prefix", F.lit("/"), wd.stem(name)).alias("item_id"),
        F.col("key").alias("corpus"), utterance.alias("kind"), name.alias("source"), none.alias("window_start"), none.alias("window_end"),
    )
    return spoken.unionByName(met).unionByName(said)


def select_items(items: DataFrame, patterns: Iterable[str] | None, column: str = "item_id") -> DataFrame:
    """Items whose id matches any shell pattern (* ? [..]); all without patterns."""
    import re

    patterns = list(patterns or [])
    if not patterns:
        return items

    def translated(pattern: str) -> str:
        out = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
        return re.sub(r"\\\[(!|)(.*?)\\\]", lambda m: f"[{'^' if m[1] else ''}{m[2]}]".replace(r"\-", "-"), out)

    return items.where(F.col(column).rlike("|".join(f"^(?s:{translated(p)})$" for p in patterns)))


def not_done(items: DataFrame, done: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Work left: rows whose key has no stored output yet."""
    return items.join(done.select(*keys), list(keys), "left_anti")


# ---- history and outcomes -----------------------------------------------------------------------
def upsert_history(history: DataFrame, entries: DataFrame) -> DataFrame:
    """`entries` put before `history`, one row per canonical path, newest first. Both have
    (path, produced_utc, ...); an entry replaces the history's row of the same path. Of rows alike in
    time the one with the larger columns, in their order, stands."""
    both = history.withColumn("__new", F.lit(0)).unionByName(entries.withColumn("__new", F.lit(1)))
    columns = history.columns
    ordered = [c for c, kind in history.dtypes if not kind.startswith("map")]
    newest = F.max_by(F.struct(*columns), F.struct("__new", "produced_utc", *[F.col(c).alias(f"__{c}") for c in ordered]))
    kept = both.groupBy(wd.canonical_path("path").alias("__key")).agg(newest.alias("e"), F.max("__new").alias("__new"))
    return kept.select("e.*", "__new", "__key").orderBy(F.desc("__new"), F.desc("produced_utc"), "__key").select(*columns)


def newest_entries(history: DataFrame, cap: int) -> DataFrame:
    """The `cap` newest entries, for a list of a stated length."""
    return history.withColumn("__key", wd.canonical_path("path")).orderBy(F.desc("produced_utc"), "__key").limit(cap).select(*history.columns)


def remove_entries(history: DataFrame, paths: DataFrame) -> DataFrame:
    keyed = history.withColumn("__key", wd.canonical_path("path"))
    return keyed.join(paths.select(wd.canonical_path("path").alias("__key")), "__key", "left_anti").select(*history.columns)


def clear_history(history: DataFrame) -> DataFrame:
    return history.limit(0)


def outputs_present(history: DataFrame, files: DataFrame) -> DataFrame:
    """`history` with present: whether every output of the entry (map outputs) is in the
    inventory `files` (path)."""
    wanted = history.select(F.col("path"), F.explode(F.map_values("outputs")).alias("output"))
    lost = wanted.join(files.select(F.col("path").alias("output")), "output", "left_anti").select("path").distinct().withColumn("__lost", F.lit(True))
    return history.join(lost, "path", "left").withColumn("present", F.col("__lost").isNull()).drop("__lost")


def history_totals(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("entries"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("seconds"))


def entries_from_documents(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """History entries of documents; `paths` gives (item_id, path, outputs)."""
    labelled = F.size(F.filter("speakers", lambda s: s["label"].isNotNull()))
    return docs.join(paths, "item_id").select(
        "path", F.coalesce("source.name", wd.file_name("path")).alias("name"), F.col("source.sha256").alias("sha256"), "duration_s", "profile",
        F.col("review.marks").alias("marks"), labelled.alias("speakers"), "produced_utc", "outputs",
    )


def outcomes(sources: DataFrame, finished: DataFrame, failures: DataFrame) -> DataFrame:
    """Every source with its outcome: ok, failed with class and message, else cancelled."""
    ok = finished.select("path").distinct().withColumn("__ok", F.lit(True))
    bad = failures.groupBy("path").agg(F.max_by(F.struct("error_class", "error"), F.struct("at", "error_class", "error")).alias("__bad"))
    joined = sources.join(ok, "path", "left").join(bad, "path", "left")
    status = F.when(F.col("__ok"), "ok").when(F.col("__bad").isNotNull(), "failed").otherwise("cancelled")
    failed = ~F.coalesce("__ok", F.lit(False))
    return joined.select(
        "path", status.alias("status"), F.when(failed, F.col("__bad.error_class")).alias("error_class"), F.when(failed, F.col("__bad.error")).alias("error")
    )


def failed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "failed")


def completed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "ok")


def run_totals(engines: DataFrame) -> DataFrame:
    """Per item: summed load and transcription seconds, and the union of library versions, the
    later engine (by place) winning."""
    versions = engines.select("item_id", "place", F.explode("versions").alias("library", "version"))
    last = versions.groupBy("item_id", "library").agg(F.max_by("version", "place").alias("version"))
    merged = last.groupBy("item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("library", "version")))).alias("versions"))
    sums = engines.groupBy("item_id").agg(F.sum("load_s").alias("load_s"), F.sum("transcribe_s").alias("transcribe_s"), F.sum("audio_s").alias("audio_s"))
    return sums.join(merged, "item_id", "left")


def stage_offsets(stages: DataFrame) -> DataFrame:
    """(stage, place, weight) with the running start of each stage; a fixed handful of rows."""
    from pyspark.sql import Window

    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("start", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
