"""Catalogue, source, document, rendering and report queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import fixtures as fx

from spanloom.fixtures import millis, table, with_cte
from spanloom.functions import wording as wd
from spanloom.operators import align as al
from spanloom.operators import catalog as ct
from spanloom.operators import counters as cn
from spanloom.operators import cues as cu
from spanloom.operators import documents as dc
from spanloom.operators import edits as ed
from spanloom.operators import labels as lb
from spanloom.operators import review as rv
from spanloom.operators import timeline as tl
from spanloom.plans import report as rp
from spanloom.queries import Registry
from spanloom.queries.review_queries import EVALUATION, MARKS
from spanloom.queries.scoring_queries import LINES, lines_of, scene_pass
from spanloom.session import scratch, settle
from spanloom.sources import annotations as an
from spanloom.sources import digests as dg
from spanloom.sources import item_files as itf
from spanloom.sources import tokens as tk


R = Registry()


def parts_files(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("folder"), F.format_string("%012d.avi", "event_id").alias("name"), F.col("ts").cast("timestamp").alias("start_utc"),
        F.col("value").alias("duration_s"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"), (F.col("event_id") % 1000).alias("bytes"),
    )


PARTS = r"""
f AS (SELECT event_type AS folder, printf('%012d.avi', event_id) AS name, epoch_us(ts) AS us, value AS dur, event_id FROM events),
st AS (SELECT *, row_number() OVER w - 1 AS n, lag(us) OVER w AS pus, lag(dur) OVER w AS pdur FROM f WINDOW w AS (PARTITION BY folder ORDER BY us, name)),
hd AS (SELECT *, max(CASE WHEN pus IS NULL OR (us - pus) / 1000000.0::DOUBLE - pdur < -2 OR (us - pus) / 1000000.0::DOUBLE - pdur > 900 THEN n END)
         OVER (PARTITION BY folder ORDER BY us, name) AS h FROM st),
parts AS (SELECT p.*, c.name AS chain, p.n - c.n AS part, (p.us - c.us) / 1000000.0::DOUBLE AS offset_s FROM hd p JOIN hd c ON c.folder = p.folder AND c.n = p.h)"""


@R.add("X5_group_parts", f"WITH {PARTS} SELECT folder, name, chain, part, round(offset_s, 6) AS offset_s FROM parts")
def x5(spark, d):
    return ct.group_parts(parts_files(spark, d)).select("folder", "name", "chain", "part", F.round("offset_s", 6).alias("offset_s"))


@R.add(
    "I11_place_parts",
    f"WITH {PARTS} SELECT folder, name, round(least(offset_s + dur, coalesce(lead(offset_s) OVER (PARTITION BY folder, chain ORDER BY part), 1e18)), 6) AS end_s FROM parts",
)
def i11(spark, d):
    return ct.place_parts(settle(ct.group_parts(parts_files(spark, d)))).select("folder", "name", F.round("end_s", 6).alias("end_s"))


@R.add(
    "S13_parts_digest",
    f"WITH {PARTS} SELECT folder, chain, sha256(string_agg(sha256(event_id::VARCHAR), '' ORDER BY part)) AS sha256, sum(event_id % 1000)::BIGINT AS bytes FROM parts GROUP BY folder, chain",
)
def s13(spark, d):
    return ct.parts_digest(ct.group_parts(parts_files(spark, d)))


@R.add("X6_part_records", f"WITH {PARTS} SELECT folder, chain, count(*) AS n_parts, string_agg(name, ',' ORDER BY part) AS names FROM parts GROUP BY folder, chain")
def x6(spark, d):
    names = F.array_join(F.transform("parts", lambda p: p["name"]), ",")
    return ct.recordings(ct.group_parts(parts_files(spark, d))).select("folder", "chain", "n_parts", names.alias("names"))


# ---- inventory ----------------------------------------------------------------------------------
EXTS = ("wav", "mp3", "WAV", "txt", "mp4", "pdf", "md")


def page_files(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("page_id") % len(EXTS) + 1).cast("int"))
    host = F.regexp_extract("url", r"^\w+://([^/]+)", 1)
    return table(spark, d, "pages").select(
        "page_id", host.alias("folder"), F.concat(F.lit("p"), F.floor(F.col("page_id") / 3).cast("string"), F.lit("."), ext).alias("name"), F.sha2("html", 256).alias("sha256")
    )


FILES = r"""
files AS (
  SELECT page_id, regexp_extract(url, '^\w+://([^/]+)', 1) AS folder,
    'p' || (page_id // 3) || '.' || ['wav', 'mp3', 'WAV', 'txt', 'mp4', 'pdf', 'md'][page_id % 7 + 1] AS name, sha256(html) AS sha256 FROM pages)"""
MEDIA = "regexp_matches(lower(name), '[.](wav|mp3|mp4)$')"


@R.add("S11_discover_media", f"WITH {FILES} SELECT DISTINCT lower(folder || '/' || name) AS path FROM files WHERE {MEDIA}")
def s11(spark, d):
    return ct.discover_media(page_files(spark, d)).select(F.col("path_key").alias("path"))


@R.add("A8_unread_types", f"WITH {FILES} SELECT '.' || regexp_extract(lower(name), '[^.]+$') AS ext, count(*) AS n FROM files WHERE NOT {MEDIA} GROUP BY ext ORDER BY n DESC, ext LIMIT 2")
def a8(spark, d):
    return ct.unread_types(page_files(spark, d), 2).withColumnRenamed("count", "n")


@R.add(
    "W9_output_base",
    f"""WITH {FILES}, s AS (SELECT folder, lower(regexp_replace(name, '[.][^.]*$', '')) AS stem, count(DISTINCT lower(name)) > 1 AS shared FROM files GROUP BY ALL)
SELECT page_id, CASE WHEN shared THEN name ELSE regexp_replace(name, '[.][^.]*$', '') END AS base FROM files JOIN s ON s.folder = files.folder AND s.stem = lower(regexp_replace(name, '[.][^.]*$', ''))""",
)
def w9(spark, d):
    return ct.output_base(page_files(spark, d)).select("page_id", "base")


@R.add(
    "X7_output_paths",
    f"""WITH {FILES}, src AS (SELECT page_id, '/' || folder || '/' || page_id || '/' || name AS path, folder AS parent, regexp_replace(name, '[.][^.]*$', '') AS base FROM files),
c AS (SELECT base, path AS recorded FROM src WHERE page_id % 5 <> 0 UNION ALL SELECT parent || '-' || base, path FROM src WHERE page_id % 2 = 0),
n AS (SELECT page_id, path, 0 AS rank, base AS name, base FROM src UNION ALL SELECT page_id, path, 1, parent || '-' || base, base FROM src UNION ALL SELECT page_id, path, 2, base || '-' || sha1(lower(path))[:8], base FROM src),
k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.base = n.name AND lower(c.recorded) <> lower(n.path)))
SELECT page_id, arg_min(name, rank) AS output FROM k GROUP BY page_id""",
)
def x7(spark, d):
    """Names claimed by many recordings each, so that all three kinds of name are given."""
    files = page_files(spark, d).select(
        "page_id", F.concat(F.lit("/"), "folder", F.lit("/"), F.col("page_id").cast("string"), F.lit("/"), "name").alias("path"), F.col("folder").alias("parent"), wd.stem("name").alias("base")
    )
    nested = files.where("page_id % 2 = 0").select(F.concat("parent", F.lit("-"), "base").alias("base"), F.col("path").alias("recorded"))
    claims = files.where("page_id % 5 <> 0").select("base", F.col("path").alias("recorded")).unionByName(nested)
    return ct.output_paths(files, claims).select("page_id", "output")


@R.add(
    "S18_list_items",
    f"""WITH {FILES}, f AS (SELECT page_id, folder AS key, name FROM files WHERE page_id % 4 <> 0), k AS (SELECT DISTINCT key FROM f), r AS (SELECT unnest(range(5)) AS n)
SELECT 0 AS section, page_id AS place, 'c/' || page_id AS item_id, key AS corpus, 'hvb-call' AS kind, CAST(page_id AS VARCHAR) AS source, CAST(NULL AS DOUBLE) AS window_start, CAST(NULL AS DOUBLE) AS window_end FROM f WHERE page_id % 3 = 0
UNION ALL SELECT 1, n, 'm/' || key || '/' || n || '/' || (10 * n) || '-' || (10 * n + 5), key, 'ami-meeting', n || '.wav', 10.0 * n, 10.0 * n + 5 FROM k, r
UNION ALL SELECT 2, n, 'm/' || key || '/' || n || '/full', key, 'ami-meeting', n || '.wav', NULL, NULL FROM k, r
UNION ALL SELECT DISTINCT 3, CAST(NULL AS BIGINT), 'u/' || regexp_replace(name, '[.][^.]*$', ''), key, 'librispeech-utterance', regexp_replace(name, '[.][^.]*$', '.flac'), NULL::DOUBLE, NULL::DOUBLE FROM f WHERE page_id % 3 = 1 AND page_id % 2 = 1""",
)
def s18(spark, d):
    """A store of three kinds of file, of which every fourth file is missing."""
    files = page_files(spark, d).withColumnRenamed("folder", "key")
    flac = F.regexp_replace("name", r"[.][^.]*$", ".flac")
    call = F.concat(F.lit("calls/"), F.col("page_id").cast("string"), F.lit("/transcript.json"))
    spoken = F.concat(F.when(F.col("page_id") % 2 == 1, "utterances/").otherwise("utterances/deeper/"), flac)
    file = F.when(F.col("page_id") % 3 == 0, call).when(F.col("page_id") % 3 == 1, spoken).otherwise(F.col("name"))
    present = files.where("page_id % 4 <> 0").select("key", file.alias("file"))
    calls = files.where("page_id % 3 = 0").select("key", F.lit("c").alias("prefix"), F.col("page_id").cast("string").alias("call"), F.col("page_id").alias("place"))
    corpora = files.select("key").distinct()
    meetings = corpora.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "key", F.lit("m").alias("prefix"), F.col("key").alias("meeting"), F.col("place").cast("string").alias("microphone"),
        F.concat(F.col("place").cast("string"), F.lit(".wav")).alias("source"), "place", (F.col("place") * 10).alias("window_start"), (F.col("place") * 10 + 5).alias("window_end"),
    )
    return ct.list_items(present, calls, meetings, corpora.select("key", F.lit("u").alias("prefix"), F.lit("utterances").alias("folder")))


@R.add("K1_item_files", "SELECT conv_id AS item_id, sha256(string_agg(text || chr(10), '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def k1(spark, d):
    """A text file per conversation, published twice (the second write stands) and read back."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), "turn", F.col("text").alias("value"))
    path = scratch(spark, "item-files")
    itf.write_items(turns.withColumn("value", F.upper("value")), path, ["turn"])
    itf.write_items(turns, path, ["turn"])
    whole = itf.read_items(spark, path).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "")
    return whole.select(F.col("item_id").cast("bigint").alias("item_id"), F.sha2(text, 256).alias("sha256"))


@R.add(
    "S12_file_digests",
    "SELECT page_id, sha256(coalesce(html, '') || chr(10)) AS sha256, CAST(octet_length(encode(coalesce(html, '') || chr(10))) AS BIGINT) AS bytes FROM pages",
)
def s12(spark, d):
    """A file per page, hashed as files: those of up to 2,000 bytes as values, longer ones as streams."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.col("html").alias("value"))
    path = scratch(spark, "page-files")
    itf.write_items(pages, path, [], "html")
    found = dg.file_digests(spark, f"{path}/{itf.versions(path)[-1]}", 2000)
    page = F.regexp_extract("path", r"(\d+)\.html$", 1).cast("bigint")
    return found.select(page.alias("page_id"), "sha256", "bytes")


@R.add(
    "J3_verify_store",
    f"""WITH {FILES} SELECT folder AS key, page_id, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 4 = 0 THEN 'unpinned' WHEN page_id % 7 = 0 THEN 'mismatch' ELSE 'verified' END AS status FROM files""",
)
def j3(spark, d):
    files = page_files(spark, d).select(F.col("folder").alias("key"), F.col("page_id").cast("string").alias("file"), "page_id", "sha256")
    lock = files.where("page_id % 4 <> 0").withColumn("sha256", F.when(F.col("page_id") % 7 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    checks = ct.verify_store(files, files.where("page_id % 11 <> 0"), lock)
    return checks.select("key", F.col("file").cast("bigint").alias("page_id"), "status")


@R.add("S17_corpora", f"WITH {FILES} SELECT folder AS key, count(*) FILTER (page_id % 11 = 0) = 0 AS complete, count(*) FILTER (page_id % 11 = 0) AS missing FROM files GROUP BY folder HAVING count(*) FILTER (page_id % 11 <> 0) > 0")
def s17(spark, d):
    files = page_files(spark, d).select(F.col("folder").alias("key"), F.col("page_id").cast("string").alias("file"), "page_id")
    return ct.corpora(files, files.where("page_id % 11 <> 0"))


# ---- history and outcomes -------------------------------------------------------------------------
def history_rows(spark, d):
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/./"), "event_type")
    return table(spark, d, "events").select(path.alias("path"), F.col("ts").cast("string").alias("produced_utc"), F.col("value").alias("duration_s"), "event_id")


@R.add(
    "X8_upsert_history",
    """WITH e AS (SELECT 'u' || user_id || '/' || event_type AS p, ts, event_id, event_id % 5 = 0 AS fresh FROM events),
k AS (SELECT p, arg_max(event_id, (fresh, ts)) AS event_id, bool_or(fresh) AS fresh, max(ts) FILTER (fresh) AS fts, max(ts) AS mts FROM e GROUP BY p)
SELECT p AS path, event_id FROM k""",
)
def x8(spark, d):
    rows = history_rows(spark, d)
    kept = ct.upsert_history(rows.where("event_id % 5 <> 0"), rows.where("event_id % 5 = 0"))
    return kept.select(wd.canonical_path("path").alias("path"), "event_id")


@R.add(
    "L5_newest_entries",
    """WITH k AS (SELECT 'u' || user_id || '/' || event_type AS p, max(ts) AS ts FROM events GROUP BY ALL)
SELECT p AS path FROM k ORDER BY ts DESC, p LIMIT 100""",
)
def l5(spark, d):
    rows = history_rows(spark, d)
    return ct.newest_entries(ct.upsert_history(rows.limit(0), rows), 100).select(wd.canonical_path("path").alias("path"))


@R.add("A15_history_totals", "SELECT count(*) AS entries, round(sum(value), 4) AS seconds FROM events")
def a15(spark, d):
    return ct.history_totals(history_rows(spark, d)).withColumn("seconds", F.round("seconds", 4))


@R.add("J19_remove_entries", "SELECT event_id FROM events WHERE event_type <> 'click'")
def j19(spark, d):
    rows = history_rows(spark, d)
    gone = rows.where(F.endswith("path", F.lit("/click"))).select(wd.canonical_path("path").alias("path")).distinct()
    return ct.remove_entries(rows, gone).select("event_id")


@R.add(
    "X9_outcomes",
    """SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 3 = 0 THEN 'ok' WHEN page_id % 3 = 1 THEN 'failed' ELSE 'cancelled' END AS status,
  CASE WHEN page_id % 3 = 1 THEN 'E' || page_id % 5 END AS error_class FROM pages""",
)
def x9(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("path"))
    failures = pages.where("page_id % 3 = 1").select("path", F.lit(1).alias("at"), F.concat(F.lit("E"), (F.col("page_id") % 5).cast("string")).alias("error_class"), F.lit("m").alias("error"))
    return ct.outcomes(pages.select("path"), pages.where("page_id % 3 = 0"), failures).drop("error")


@R.add(
    "T20_load_verdicts",
    """SELECT event_id, CASE WHEN value > 10 THEN round(greatest(0.0, ((event_id % 50) - value) / (value - 10)), 6) END AS load,
  CASE WHEN value > 10 THEN greatest(0.0, ((event_id % 50) - value) / (value - 10)) > 0.5 END AS busy FROM events""",
)
def t20(spark, d):
    zero, e = F.lit(0.0), F.col("event_id")
    snap = lambda wall, total, own: F.struct(wall.alias("wall_s"), total.alias("total_cpu_s"), own.alias("self_cpu_s"))
    rows = table(spark, d, "events").select("event_id", snap(F.lit(10.0), zero, zero).alias("b"), snap(F.col("value"), (e % 50).cast("double"), F.col("value")).alias("a"))
    load = wd.other_load("b", "a")
    return rows.select("event_id", F.round(load, 6).alias("load"), wd.busy(load).alias("busy"))


@R.add(
    "P6_speed_table",
    """SELECT event_type AS variant, count(*) FILTER (event_id % 3 = 0) AS rows_, count(*) FILTER (event_id % 3 <> 0) AS excluded,
  round(sum(value) FILTER (event_id % 3 = 0), 4) AS audio_s, round(sum(value) FILTER (event_id % 3 = 0) / sum(event_id % 7 + 1) FILTER (event_id % 3 = 0), 4) AS rate FROM events GROUP BY event_type""",
)
def p6(spark, d):
    e = F.col("event_id")
    busy = F.when(e % 3 == 0, F.lit(False)).when(e % 3 == 1, F.lit(True))
    runs = table(spark, d, "events").select(F.col("event_type").alias("variant"), F.col("value").alias("audio_s"), (e % 7 + 1).cast("double").alias("transcribe_s"), busy.alias("busy"))
    return rp.speed_table(runs).select("variant", F.col("rows").alias("rows_"), "excluded", F.round("audio_s", 4).alias("audio_s"), F.round("rate", 4).alias("rate"))


@R.add(
    "P7_channel_delays",
    """SELECT user_id AS item_id, event_type AS role, string_agg(d, ',' ORDER BY d) AS delays FROM (
  SELECT DISTINCT user_id, event_type, printf('%.3f', (event_id % 13) / 1000.0::DOUBLE) AS d FROM events) GROUP BY user_id, event_type""",
)
def p7(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("speaker_role"), (F.col("event_id") % 13 + 5).alias("offset_ms"), F.lit(5).alias("start_ms"))
    return rp.channel_delays(rows).select("item_id", "role", F.array_join(F.transform("delays", lambda v: F.format_string("%.3f", v)), ",").alias("delays"))


# ---- words from segments ---------------------------------------------------------------------------
@R.add(
    "E1_spread_words",
    with_cte("SELECT item_id, turn * 1000000 + pos AS seq, text, s AS start_ms, e AS end_ms FROM ref_words WHERE text <> ''"),
)
def e1(spark, d):
    return an.spread_words(fx.ref_segments(spark, d)).select("item_id", "seq", "text", millis("start").alias("start_ms"), millis("end").alias("end_ms"))


@R.add("E2_spread_over_speech")
def e2(spark, d):
    segs = fx.ref_segments(spark, d).select(
        "item_id", F.lit(0).alias("window"), "seg", "start", (F.col("end") - F.col("start")).alias("duration"), "text", F.lit(1e9).alias("window_len"), F.lit(0.0).alias("offset")
    )
    words = tk.spread_over_speech(tk.segment_spans(segs), fx.turns(spark, d))
    return words.select("item_id", "seg", "pos", "text", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


@R.add(
    "E3_group_words",
    with_cte(
        "SELECT item_id, turn AS seg, pos * 2 AS seq, text, s AS start_ms, s + CASE WHEN length(text) > 3 THEN 260 ELSE 160 END AS end_ms FROM ref_words WHERE text <> ''"
    ),
)
def e3(spark, d):
    words = fx.ref_words(spark, d)
    halves = F.array(F.struct(F.lit(0).alias("h"), F.concat(F.lit(" "), F.substring("text", 1, 3)).alias("token")), F.struct(F.lit(1).alias("h"), F.expr("substring(text, 4)").alias("token")))
    each = words.select("item_id", F.col("turn").alias("seg"), "pos", "start", F.inline(halves)).where("token <> ''")
    tokens = each.select("item_id", "seg", (F.col("pos") * 2 + F.col("h")).alias("pos"), "token", (F.col("start") + 0.1 * F.col("h")).alias("time"), F.lit(0.16).alias("duration"))
    segments = fx.ref_segments(spark, d).select("item_id", "seg", "end", F.lit(0.0).alias("offset"))
    out = tk.group_words(tokens, segments)
    return out.select("item_id", "seg", "seq", "text", millis("start").alias("start_ms"), millis("end").alias("end_ms"))


@R.add("I10_stream_clock", with_cte("SELECT item_id, coalesce(sum(e - s) OVER (PARTITION BY item_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_ms, s AS clip_ms FROM turns"))
def i10(spark, d):
    clock = tk.stream_clock(fx.turns(spark, d).select("item_id", "start", "end"), 1000)
    return clock.select("item_id", millis("stream_start").alias("stream_ms"), millis("clip_start").alias("clip_ms"))


@R.add(
    "S9_utterance_texts",
    r"SELECT split_part(line, ' ', 1) AS utterance, trim(substr(line, length(split_part(line, ' ', 1)) + 2)) AS text FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM benchmark) WHERE line <> ''",
)
def s9(spark, d):
    return an.utterance_texts(table(spark, d, "benchmark"), "text")


@R.add(
    "S10_fill_segments",
    with_cte(
        """SELECT g.item_id, g.turn AS seg, coalesce((SELECT string_agg(w.text, ' ' ORDER BY w.s, w.e, w.text) FROM published w
  WHERE w.item_id = g.item_id AND w.speaker = g.speaker AND w.s >= g.start_ms AND w.s < g.start_ms + g.dur), '') AS text FROM seg g"""
    ),
)
def s10(spark, d):
    segments = fx.ref_segments(spark, d).drop("text")
    return an.fill_segments(segments, fx.published(spark, d)).select("item_id", "seg", "text")


@R.add(
    "F3_cut_reference",
    with_cte("SELECT item_id, turn AS seg, greatest(start_ms, 20000) - 20000 AS start_ms, least(start_ms + dur, 90000) - 20000 AS end_ms FROM seg WHERE least(start_ms + dur, 90000) > greatest(start_ms, 20000)"),
)
def f3(spark, d):
    cut = an.cut_segments(fx.ref_segments(spark, d), 20.0, 90.0)
    return cut.select("item_id", "seg", millis("start").alias("start_ms"), millis("end").alias("end_ms"))


# ---- documents, renderings, edits ---------------------------------------------------------------------
_DOCUMENTS: dict[tuple[str, str], object] = {}


def documents(spark, d):
    """The documents the renderings and edits below start from, built once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _DOCUMENTS:
        _DOCUMENTS[key] = built_documents(spark, d)
    return _DOCUMENTS[key]


def built_documents(spark, d):
    lines = settle(lines_of(spark, d))
    marks = settle(rv.build_review(fx.published(spark, d), fx.detector(spark, d), fx.items(spark, d)))
    scenes = settle(scene_pass(spark, d)[0])
    facts = fx.items(spark, d).withColumns(
        {"name": F.format_string("conv%05d.wav", "item_id"), "sha256": F.sha2(F.col("item_id").cast("string"), 256), "bytes": F.lit(1000), "profile": F.lit("standard"), "produced_utc": F.lit("2024-01-01T00:00:00Z")}
    )
    return settle(dc.build_document(facts, lines, marks, scenes, lb.named_speakers(lb.summarise_speakers(lines))))


def decisions(docs):
    k = F.col("mark") % 3
    named = F.col("item_id") % 3
    speaker = F.when(named == 1, F.lit("")).when(named == 2, F.lit("spk_user"))
    return dc.marks_of(docs).select(
        "item_id", "mark", F.when(k == 0, "text").when(k == 1, "nothing").otherwise("open").alias("status"),
        F.when(k == 0, F.lit("heard words")).otherwise(F.lit("")).alias("note"), speaker.alias("speaker"),
    )


@R.add(
    "K2_build_document",
    with_cte(
        """, sp AS (SELECT item_id, speaker, sum(n_words)::BIGINT AS words, sum(e - s)::BIGINT AS ms, min(s) AS s FROM lines GROUP BY item_id, speaker)
SELECT i.item_id, (SELECT count(*) FROM lines l WHERE l.item_id = i.item_id) AS n_lines,
  (SELECT md5(coalesce(string_agg(text, ' ' ORDER BY s, e), '')) FROM lines l WHERE l.item_id = i.item_id) AS line_texts,
  (SELECT md5(coalesce(string_agg(s || '-' || e || ':' || coalesce(speaker, '?'), ',' ORDER BY s, e), '')) FROM lines l WHERE l.item_id = i.item_id) AS line_spans,
  (SELECT md5(coalesce(string_agg(s || '-' || e || ':' || text, ' ' ORDER BY s, e, seq), '')) FROM labelled w WHERE w.item_id = i.item_id) AS words,
  (SELECT md5(coalesce(string_agg(play_s || '-' || play_e || ' ' || span_s || '-' || span_e || ':' || detector_words, ',' ORDER BY mark), '')) FROM marks m WHERE m.item_id = i.item_id) AS marks,
  (SELECT coalesce(string_agg(coalesce(speaker, '?') || '=' || words || '/' || ms, ',' ORDER BY speaker IS NULL, s, speaker), '') FROM sp WHERE sp.item_id = i.item_id) AS speakers,
  'conv' || printf('%05d', i.item_id) AS outputs, i.audio_ms FROM items i""",
        LINES + "," + MARKS.lstrip(),
    ),
)
def k2(spark, d):
    docs = built_documents(spark, d)
    span = lambda x, s, e: F.concat(millis(x[s]).cast("string"), F.lit("-"), millis(x[e]).cast("string"))
    listed = lambda c, row, by: F.array_join(F.transform(c, row), by)
    digest = lambda text: F.md5(text.cast("binary"))
    words = F.flatten(F.transform("lines", lambda l: l["words"]))
    return docs.select(
        "item_id", F.size("lines").alias("n_lines"), digest(listed("lines", lambda l: l["text"], " ")).alias("line_texts"),
        digest(listed("lines", lambda l: F.concat(span(l, "start", "end"), F.lit(":"), F.coalesce(l["speaker"], F.lit("?"))), ",")).alias("line_spans"),
        digest(listed(words, lambda w: F.concat(span(w, "s", "e"), F.lit(":"), w["w"]), " ")).alias("words"),
        digest(listed("marks", lambda m: F.concat(span(m, "start", "end"), F.lit(" "), span(m, "span_start", "span_end"), F.lit(":"), m["detector_words"].cast("string")), ",")).alias("marks"),
        listed("speakers", lambda s: F.concat(F.coalesce(s["label"], F.lit("?")), F.lit("="), s["words"].cast("string"), F.lit("/"), millis(s["seconds"]).cast("string")), ",").alias("speakers"),
        "source.outputs", millis("duration_s").alias("audio_ms"),
    )


HEADER = r"""
SELECT o_orderkey AS item_id, md5(concat_ws(chr(10), k || '.wav',
  'Duration ' || printf('%d:%02d', k % 3600 // 60, k % 60) || '   |   0 speakers   |   produced ' || o_orderpriority || '   |   ' || CASE WHEN k % 2 = 0 THEN 'version ' || k || ', ' ELSE '' END || 'quality level ' || o_orderstatus,
  'Published engine: ' || o_orderstatus || ' ' || o_orderpriority || CASE WHEN k % 3 = 0 THEN ' (fast)' ELSE '' END,
  'Checked against: ' || CASE WHEN k % 4 = 0 THEN 'none' ELSE o_orderpriority END || '; its text is never published'
    || CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN '; its word times are approximate, so the review list may miss short gaps' ELSE '' END,
  CASE WHEN k % 2 = 1 THEN 'Speaker labels: voices' || CASE WHEN k % 9 > 4
    THEN ', speaker count fixed at ' || (k % 9) || ' (a speaker the models cannot separate is then hidden inside another label)'
    ELSE ', clustering threshold ' || rtrim(rtrim(printf('%.2f', k % 97 / 100.0::DOUBLE), '0'), '.')
      || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ', 1 small label folded into the nearest voice' ELSE ', 2 small labels folded into the nearest voice' END END END,
  CASE WHEN k % 7 = 0 THEN 'Speaker labelling did not complete: ' || o_orderpriority END, '', 'Speakers', '  (no words were published)', '',
  'Review list: no span where speech may be missing was found.',
  CASE WHEN k % 4 > 0 OR k % 3 > 0 THEN 'Set aside: ' || concat_ws('; ',
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '1 word the published engine wrote inside music or noise was set aside (listed in the run record)'
      ELSE (k % 4) || ' words the published engine wrote inside music or noise were set aside (listed in the run record)' END,
    CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '1 word the second engine placed inside silence, music or noise was left out of the review list'
      ELSE (k % 3) || ' words the second engine placed inside silence, music or noise were left out of the review list' END) || '.' END,
  'A transcript is a draft until it has been verified against the recording.', '', 'Transcript', '')) AS digest
FROM (SELECT *, o_orderkey AS k FROM orders)"""


@R.add("K4_header_rows", HEADER)
def k4_header(spark, d):
    """Headers of documents without words, one an order, with every fact a run can tell."""
    k, none = F.col("item_id"), lambda t: F.lit(None).cast(t)
    engine = lambda name, model, preset, timing: F.struct(name.alias("engine"), model.alias("model"), preset.alias("preset"), timing.alias("word_timing"))
    publisher = engine(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(k % 3 == 0, "fast"), none("string"))
    detector = F.when(k % 4 != 0, engine(F.lit(""), F.col("o_orderpriority"), F.lit(""), F.when(k % 5 == 0, "segment")))
    settings = F.struct(F.when(k % 9 > 4, k % 9).alias("num_speakers"), (k % 97 / 100.0).alias("threshold"), (k % 3).alias("labels_folded"))
    voices = F.when(k % 2 == 1, F.struct(F.lit("voices").alias("engine"), F.lit(1).alias("labels_found"), settings.alias("settings"), none("map<string,double>").alias("seconds_per_label")))
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "item_id")
    facts = orders.select(
        "item_id", F.concat(k.cast("string"), F.lit(".wav")).alias("name"), F.lit("").alias("sha256"), k.alias("bytes"), (k % 3600).cast("double").alias("audio_s"),
        F.col("o_orderstatus").alias("profile"), F.col("o_orderpriority").alias("produced_utc"), F.when(k % 2 == 0, k.cast("string")).alias("version"),
        F.struct(publisher.alias("publisher"), detector.alias("detector"), voices.alias("diarization")).alias("engines"),
        F.when(k % 7 == 0, F.col("o_orderpriority")).alias("speaker_failure"),
    )
    # The words set aside of each source, as the scene pass leaves them.
    gone = F.concat(F.array_repeat(F.lit("publisher"), (k % 4).cast("int")), F.array_repeat(F.lit("detector"), (k % 3).cast("int")))
    aside = orders.select("item_id", F.explode(gone).alias("source"))
    empty = lambda schema: spark.createDataFrame([], "item_id bigint, " + schema)
    totals = cn.non_speech_totals(orders.select("item_id"), empty("kind string, start double, end double"), aside, empty("n int"))
    docs = dc.build_document(
        dc.with_non_speech(facts, totals), empty(f"start double, end double, speaker string, text string, words array<{dc.WORD}>"),
        empty("mark int, start double, end double, span_start double, span_end double, detector_words int"),
        empty("start double, end double, kind string, label string, probability double"), empty("place int, speaker string, name string, words bigint, seconds double"),
    )
    rows = dc.header_rows(docs).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows"))
    return rows.select("item_id", F.md5(F.array_join(F.transform("rows", lambda r: r["value"]), "\n").cast("binary")).alias("digest"))


@R.add(
    "K3_marks_with_reference",
    with_cte(
        """, hits AS (SELECT m.item_id, m.mark, r.speaker, r.s FROM marks m JOIN ref_words r ON r.item_id = m.item_id AND m.span_s < r.e AND r.s < m.span_e),
sp AS (SELECT item_id, mark, string_agg(speaker, ',' ORDER BY f) AS speakers FROM (SELECT item_id, mark, speaker, min(s) AS f FROM hits GROUP BY ALL) GROUP BY ALL)
SELECT m.item_id, m.mark, count(h.s) AS reference_words, coalesce(any_value(sp.speakers), '') AS reference_speakers
FROM marks m LEFT JOIN hits h ON h.item_id = m.item_id AND h.mark = m.mark LEFT JOIN sp ON sp.item_id = m.item_id AND sp.mark = m.mark GROUP BY m.item_id, m.mark""",
        MARKS,
    ),
)
def k3(spark, d):
    marks = settle(rv.build_review(fx.published(spark, d), fx.detector(spark, d), fx.items(spark, d)))
    out = dc.marks_with_reference(marks, fx.ref_words(spark, d))
    return out.select("item_id", "mark", "reference_words", F.array_join("reference_speakers", ",").alias("reference_speakers"))


@R.add(
    "T16_gap_context",
    with_cte(
        """, pw AS (SELECT item_id, s, text, row_number() OVER (PARTITION BY item_id ORDER BY s, seq) AS n FROM published),
ctx AS (SELECT m.item_id, m.mark, (SELECT count(*) FROM pw WHERE pw.item_id = m.item_id AND pw.s < m.span_s) AS k, (SELECT count(*) FROM pw WHERE pw.item_id = m.item_id) AS t FROM marks m)
SELECT item_id, mark, (CASE WHEN k > 14 THEN '... ' ELSE '' END)
  || coalesce((SELECT string_agg(text, ' ' ORDER BY n) FROM pw WHERE pw.item_id = ctx.item_id AND n <= k AND n > k - 14) || ' ', '') || '[ GAP ]'
  || coalesce(' ' || (SELECT string_agg(text, ' ' ORDER BY n) FROM pw WHERE pw.item_id = ctx.item_id AND n > k AND n <= k + 14), '')
  || (CASE WHEN t > k + 14 THEN ' ...' ELSE '' END) AS context FROM ctx""",
        MARKS,
    ),
)
def t16(spark, d):
    marks = settle(rv.build_review(fx.published(spark, d), fx.detector(spark, d), fx.items(spark, d)))
    return dc.gap_context(marks, fx.published(spark, d))


@R.add(
    "M3_review_applied",
    with_cte(
        """SELECT i.item_id, count(m.mark) FILTER (m.mark % 3 = 0) AS text, count(m.mark) FILTER (m.mark % 3 = 1) AS nothing, count(m.mark) FILTER (m.mark % 3 = 2) AS open,
  2 * count(m.mark) FILTER (m.mark % 3 = 0) AS listener_words, coalesce(any_value(p.words), 0) + 2 * count(m.mark) FILTER (m.mark % 3 = 0) AS words
FROM items i LEFT JOIN marks m USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS words FROM published GROUP BY item_id) p USING (item_id) GROUP BY i.item_id""",
        MARKS,
    ),
)
def m3_counts(spark, d):
    """Counters of the applied review, and all words of the revised documents: none lost."""
    docs = documents(spark, d)
    out = settle(ed.apply_resolutions(docs, decisions(docs)))
    words = F.aggregate("lines", F.lit(0), lambda n, l: n + F.size(l["words"]))
    return out.select("item_id", "review_applied.text", "review_applied.nothing", "review_applied.open", "review_applied.listener_words", words.alias("words"))


@R.add("M3_apply_resolutions")
def m3(spark, d):
    docs = documents(spark, d)
    out = settle(ed.apply_resolutions(docs, decisions(docs)))
    return out.select(
        "item_id", F.size("lines").alias("n_lines"), "review_applied.text", "review_applied.nothing", "review_applied.open", "review_applied.listener_words",
        F.md5(F.array_join(F.transform("lines", lambda l: l["text"]), "|").cast("binary")).alias("digest"),
    )


@R.add(
    "B4_infer_speaker",
    with_cte(
        """SELECT m.item_id, m.mark, CASE WHEN h.speaker IS NOT NULL THEN h.speaker WHEN b.speaker = a.speaker THEN b.speaker END AS speaker
FROM marks m
LEFT JOIN LATERAL (SELECT speaker FROM lines l WHERE l.item_id = m.item_id AND l.s < m.span_s AND l.e > m.span_e ORDER BY l.s, l.e LIMIT 1) h ON true
LEFT JOIN LATERAL (SELECT speaker FROM lines l WHERE l.item_id = m.item_id AND l.e <= m.span_s ORDER BY l.e DESC, l.s LIMIT 1) b ON true
LEFT JOIN LATERAL (SELECT speaker FROM lines l WHERE l.item_id = m.item_id AND l.s >= m.span_e ORDER BY l.s, l.e LIMIT 1) a ON true""",
        LINES + "," + MARKS.lstrip(),
    ),
)
def b4(spark, d):
    lines = settle(lb.build_lines(lb.label_words(fx.published(spark, d), fx.turns(spark, d))))
    marks = settle(rv.build_review(fx.published(spark, d), fx.detector(spark, d), fx.items(spark, d)))
    return ed.infer_speakers(marks, lines.withColumnRenamed("line_key", "line"))


def session_rows(spark, d):
    """One entry per turn, as if turns were marks; some recordings lack one, some have odd times."""
    marks = fx.turns(spark, d).select("item_id", F.col("seq").cast("int").alias("mark"), "start", "end")
    k = F.col("item_id") % 5
    status = F.element_at(F.array(*[F.lit(x) for x in ("text", "nothing", "open", "strange")]), (F.col("mark") % 4 + 1).cast("int"))
    entries = marks.where(~((k == 0) & (F.col("mark") == 2))).withColumns(
        {"start": F.when(k == 1, F.col("start") + 0.5).otherwise(F.col("start")), "status": status, "note": F.lit("n"), "speaker": F.lit(None).cast("string")}
    )
    return marks, entries


@R.add(
    "S4_valid_sessions",
    with_cte(
        """SELECT item_id, turn AS mark, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'nothing' ELSE 'open' END AS status FROM turns t
WHERE item_id % 5 <> 1 AND NOT (item_id % 5 = 0 AND EXISTS (SELECT 1 FROM turns x WHERE x.item_id = t.item_id AND x.turn = 2))"""
    ),
)
def s4(spark, d):
    marks, entries = session_rows(spark, d)
    return ed.valid_sessions(entries, marks, check_times=True).select("item_id", "mark", "status")


@R.add(
    "R6_mark_resolution",
    with_cte(
        """SELECT item_id, turn AS mark, turn % 2 = 1 AS recorded, CASE WHEN turn % 2 = 1 THEN 'text' WHEN turn % 4 = 0 THEN 'text' END AS status FROM turns"""
    ),
)
def r6(spark, d):
    marks, entries = session_rows(spark, d)
    session = marks.withColumns({"status": F.when(F.col("mark") % 4 == 0, "text").otherwise("open"), "note": F.lit("n")})
    own = marks.withColumns({"status": F.when(F.col("mark") % 2 == 1, "text").otherwise("open"), "note": F.lit("own")})
    return rv.mark_resolution(own, session).select("item_id", "mark", "recorded", "status")


@R.add(
    "T13_scene_wording",
    r"""SELECT event_id, CASE WHEN w < 60 THEN w || ' s' WHEN w % 60 > 0 THEN (w // 60) || ' min ' || (w % 60) || ' s' ELSE (w // 60) || ' min' END AS length,
  CASE kind WHEN 'silence' THEN '[silence]' WHEN 'music' THEN '[music]' WHEN 'noise' THEN '[background noise]' ELSE '[sound: ' || event_type || ']' END AS tag
FROM (SELECT event_id, event_type, round_even(value * 3.0::DOUBLE, 0)::BIGINT AS w, ['silence', 'music', 'noise', 'sound'][event_id % 4 + 1] AS kind FROM events)""",
)
def t13(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("silence", "music", "noise", "sound")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", wd.format_seconds(F.col("value") * 3.0).alias("length"), wd.scene_tag(kind, F.col("event_type")).alias("tag"))


@R.add("L6_transcript_entries")
def l6(spark, d):
    docs = documents(spark, d)
    return cu.transcript_entries(dc.lines_of(docs), dc.scenes_of(docs), dc.marks_of(docs)).select("item_id", F.round("start", 4).alias("start"), "rank", "entry", "label", "text")


@R.add(
    "M1_strip_listener",
    with_cte(
        """SELECT i.item_id, count(l.text) AS n_lines, coalesce(sum(l.n_words), 0)::BIGINT AS n_words, md5(coalesce(string_agg(l.text, '|' ORDER BY l.s, l.e), '')) AS digest,
  md5(coalesce(string_agg(l.s || '-' || l.e || ':' || coalesce(l.speaker, '?'), ',' ORDER BY l.s, l.e), '')) AS spans, 0 AS resolved, false AS reviewed
FROM items i LEFT JOIN lines l USING (item_id) GROUP BY i.item_id""",
        LINES,
    ),
)
def m1(spark, d):
    """Stripping what was applied gives the lines there were, as the oracle builds them."""
    docs = documents(spark, d)
    bare = ed.strip_listener(settle(ed.apply_resolutions(docs, decisions(docs))))
    span = lambda l: F.concat(millis(l["start"]).cast("string"), F.lit("-"), millis(l["end"]).cast("string"), F.lit(":"), F.coalesce(l["speaker"], F.lit("?")))
    return bare.select(
        "item_id", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, l: n + F.size(l["words"])).alias("n_words"),
        F.md5(F.array_join(F.transform("lines", lambda l: l["text"]), "|").cast("binary")).alias("digest"),
        F.md5(F.array_join(F.transform("lines", span), ",").cast("binary")).alias("spans"),
        F.size(F.filter("marks", lambda m: m["resolution"].isNotNull())).alias("resolved"), F.col("review_applied").isNotNull().alias("reviewed"),
    )


@R.add("V1_build_cues")
def v1(spark, d):
    docs = documents(spark, d)
    return cu.build_cues(dc.lines_of(docs), dc.scenes_of(docs), dc.speaker_names(docs)).withColumns({"start": F.round("start", 4), "end": F.round("end", 4)})


@R.add("K5_srt_blocks")
def k5(spark, d):
    docs = documents(spark, d)
    return cu.srt_blocks(cu.build_cues(dc.lines_of(docs), dc.scenes_of(docs), dc.speaker_names(docs)))


@R.add("K4_text_rows")
def k4(spark, d):
    return dc.text_rows(documents(spark, d))


@R.add(
    "T10_clock_and_cue_times",
    r"""SELECT event_id, printf('%d:%02d.%d', t // 600, (t // 10) % 60, t % 10) AS short_, CASE WHEN t >= 36000 THEN printf('%d:%02d:%02d.%d', t // 36000, (t // 600) % 60, (t // 10) % 60, t % 10)
  ELSE printf('%d:%02d.%d', t // 600, (t // 10) % 60, t % 10) END AS clock_, printf('%02d:%02d:%02d,%03d', m // 3600000, (m // 60000) % 60, (m // 1000) % 60, m % 1000) AS srt
FROM (SELECT event_id, round_even(x * 10.0::DOUBLE, 0)::BIGINT AS t, round_even(x * 1000.0::DOUBLE, 0)::BIGINT AS m FROM (SELECT event_id, value * 37.0::DOUBLE AS x FROM events))""",
)
def t10(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("value") * 37.0).alias("x"))
    return rows.select("event_id", wd.minutes_clock("x").alias("short_"), wd.clock("x").alias("clock_"), wd.cue_time("x", ",").alias("srt"))


# ---- report ---------------------------------------------------------------------------------------------
@R.add(
    "P5_review_table",
    with_cte(
        """SELECT item_id, '| ' || item_id || ' | ' || marks || ' | ' || marks_on_speech || ' | ' || printf('%.1f', CASE WHEN marks > 0 THEN 100.0::DOUBLE * (marks_on_speech / marks::DOUBLE) ELSE 0.0 END)
  || ' | ' || dropped_words || ' | ' || dropped_covered || ' | ' || printf('%.1f', CASE WHEN dropped_words > 0 THEN 100.0::DOUBLE * (dropped_covered / dropped_words::DOUBLE) ELSE 0.0 END)
  || ' | ' || printf('%.1f', 100.0::DOUBLE * (round(review_ms / 1000.0::DOUBLE, 6) / (audio_ms / 1000.0::DOUBLE))) || ' | annotated |' AS value FROM counts""",
        EVALUATION,
    ),
)
def p5(spark, d):
    items = fx.items(spark, d).withColumn("word_times", F.lit("annotated"))
    scores = rv.review_scores(fx.published(spark, d), fx.detector(spark, d), fx.ref_words(spark, d), items)
    return rp.review_table(scores).select("item_id", "value")


@R.add("K7_render_report")
def k7(spark, d):
    items = fx.items(spark, d).withColumn("word_times", F.lit("annotated"))
    words = fx.published(spark, d).withColumn("variant", F.lit("publisher")).unionByName(fx.detector(spark, d).withColumn("variant", F.lit("detector")))
    s = rp.score_all(fx.ref_words(spark, d), fx.ref_segments(spark, d), words, fx.turns(spark, d), items, "publisher", "detector")
    tables = {
        "accuracy": rp.accuracy_table(s["errors"]), "items": rp.item_table(s["errors"], s["recall"], items),
        "diarization": rp.diarization_table(s["diarization"]), "review": rp.review_table(s["review"]),
    }
    return rp.render_report(tables)
