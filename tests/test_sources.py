"""Annotation readers, tokens to words, inventories, stores, exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import catalog as ct
from spanloom.operators import documents as dc
from spanloom.operators import series as se
from spanloom.plans import report as rp
from spanloom.sources import annotations as an
from spanloom.sources import files as fl
from spanloom.sources import tokens as tk
from test_documents import decide, document


def test_call_transcripts(spark, tmp_path):
    rows = [
        {"index": 2, "offset_ms": 9000, "start_ms": 8500, "duration_ms": 1000, "speaker_role": "caller", "human_transcript": "yes please"},
        {"index": 1, "offset_ms": 3720, "start_ms": 3720, "duration_ms": 2670, "speaker_role": "agent", "human_transcript": "hello how can i help"},
        {"index": 3, "offset_ms": 9500, "start_ms": 9000, "duration_ms": 100, "speaker_role": "caller", "human_transcript": "  "},
        {"index": 4, "offset_ms": 12000, "start_ms": 12000, "duration_ms": 500, "speaker_role": "agent", "human_transcript": "bye"},
    ]
    (tmp_path / "call1.json").write_text(json.dumps(rows))
    transcript = an.read_call_transcripts(spark, str(tmp_path))
    segments = an.call_segments(transcript).orderBy("start").collect()
    assert [(s.item_id, round(s.start, 3), round(s.end, 3), s.speaker) for s in segments] == [("call1", 3.72, 6.39, "agent"), ("call1", 9.0, 10.0, "caller"), ("call1", 12.0, 12.5, "agent")]
    words = an.spread_words(an.call_segments(transcript)).orderBy("start").collect()
    assert [w.text for w in words][:5] == ["hello", "how", "can", "i", "help"] and abs(words[1].start - (3.72 + 2.67 / 5)) < 1e-9
    delays = {r.role: r.delays for r in rp.channel_delays(transcript).collect()}
    assert delays == {"agent": [0.0], "caller": [0.5]}
    differences = spark.createDataFrame([("call1", 0.0)], "item_id string, channel_difference_s double")
    notes = [r.note for r in rp.delay_notes(rp.channel_delays(transcript), differences).collect()]
    assert notes == ["caller channel delay in the transcript is 0.500 s against 0.000 s from the channel lengths; segment times may be off"]


def test_meeting_xml(spark, tmp_path):
    (tmp_path / "words").mkdir()
    (tmp_path / "segments").mkdir()
    (tmp_path / "words" / "M1.A.words.xml").write_text(
        '<root><w starttime="781.0" endtime="781.2">Hi</w><w starttime="781.2" endtime="781.2" punc="true">,</w><w starttime="780.5" endtime="780.9">Okay</w>'
        '<vocalsound starttime="1" endtime="2"/><w starttime="3">late</w><w starttime="990.0" endtime="991.0">after</w></root>'
    )
    (tmp_path / "segments" / "M1.A.segments.xml").write_text('<root><segment transcriber_start="770.0" transcriber_end="781.1"/><segment transcriber_start="5.0"/></root>')
    (tmp_path / "meetings.xml").write_text('<root><meeting observation="M1"><speaker nxt_agent="A" global_name="FEE005"/><speaker nxt_agent="B" global_name="MEE006"/></meeting></root>')
    names = an.read_meeting_speakers(spark, str(tmp_path / "meetings.xml"))
    words = an.meeting_words(an.read_meeting_words(spark, str(tmp_path / "words")), names)
    assert [(w.item_id, w.speaker, w.text) for w in words.orderBy("start").collect()] == [("M1", "FEE005", "Okay"), ("M1", "FEE005", "Hi"), ("M1", "FEE005", "after")]
    segments = an.meeting_segments(an.read_meeting_segments(spark, str(tmp_path / "segments")), names)
    cut_w, cut_s = an.cut_words(words, 780.0, 960.0), an.cut_segments(segments, 780.0, 960.0)
    assert [(w.text, round(w.start, 3), round(w.end, 3)) for w in cut_w.orderBy("start").collect()] == [("Okay", 0.5, 0.9), ("Hi", 1.0, 1.2)]
    filled = an.fill_segments(cut_s, cut_w).collect()
    assert [(s.start, round(s.end, 3), s.text) for s in filled] == [(0.0, 1.1, "Okay Hi")]
    assert an.reference_speakers(cut_w, cut_s).first().speakers == ["FEE005"]
    with pytest.raises(ValueError):
        an.cut_words(words, 5.0, 5.0)


def test_utterances(spark):
    lines = spark.createDataFrame([("1-2-0001 HELLO THERE WORLD",), ("  ",), ("1-2-0002",)], "value string")
    texts = an.utterance_texts(lines)
    assert sorted(tuple(r) for r in texts.collect()) == [("1-2-0001", "HELLO THERE WORLD"), ("1-2-0002", "")]
    items = spark.createDataFrame([(7, "1-2-0001", 2.0)], "item_id long, utterance string, audio_s double")
    assert [r.text for r in an.utterance_reference(texts, items).orderBy("seq").collect()] == ["hello", "there", "world"]


def test_engine_records(spark, tmp_path):
    record = {"item_id": "i", "variant": "v", "kind": "transcript", "words": [{"text": "a", "start": 0.0, "end": 1.0}], "timing": {"audio_s": 9.0, "load_s": 1.0, "transcribe_s": 3.0}, "verdict": {"busy": False}}
    (tmp_path / "i__v.json").write_text(json.dumps(record, indent=1))
    records = an.read_engine_records(spark, str(tmp_path))
    assert an.engine_words(records).first().text == "a" and an.engine_runs(records).first().transcribe_s == 3.0
    row = rp.speed_table(an.engine_runs(records)).first()
    assert row.value == "| v | 1 | 9 | 3.0 | 3.00 | 0 |"


def test_tokens_to_words(spark):
    rows = [(1, 0, 0, " he", 0.0, 0.1), (1, 0, 1, "llo", 0.2, 0.2), (1, 0, 2, " ", 0.5, 0.1), (1, 0, 3, " wor", 0.9, None), (1, 0, 4, "ld", None, None)]
    tokens = spark.createDataFrame(rows, "item_id long, seg int, pos int, token string, time double, duration double")
    segments = spark.createDataFrame([(1, 0, 2.0, 10.0)], "item_id long, seg int, end double, offset double")
    got = [(w.text, round(w.start, 3), round(w.end, 3)) for w in tk.group_words(tokens, segments).orderBy("seq").collect()]
    assert got == [("hello", 10.0, 10.4), ("world", 10.9, 10.98)]
    plain = tokens.withColumn("duration", F.lit(None).cast("double"))
    got = [(w.text, round(w.start, 3), round(w.end, 3)) for w in tk.group_words(plain, segments).orderBy("seq").collect()]
    assert got == [("hello", 10.0, 10.9), ("world", 10.9, 12.0)]
    assert tk.segment_text(tk.group_words(tokens, segments)).first().text == "hello world"


def spread_by_hand(tokens, parts):
    total, weights = sum(e - s for s, e in parts), [len(t) + 1 for t in tokens]

    def real(v, start):
        for k, (s, e) in enumerate(parts):
            if v < e - s or (v <= e - s and (not start or k == len(parts) - 1)):
                return s + v
            v -= e - s
        return parts[-1][1]

    out, at = [], 0.0
    for t, w in zip(tokens, weights):
        size = total * w / sum(weights)
        out.append((t, real(at, True), real(at + size, False)))
        at += size
    return out


def test_spread_over_speech_at_random(spark):
    rng = random.Random(6)
    spans, voiced, want = [], [], {}
    for i in range(25):
        tokens = ["x" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 8))]
        parts, t = [], 1.0
        for _ in range(rng.randrange(4)):
            t += rng.uniform(0.2, 2)
            parts.append((t, t + rng.uniform(0.5, 3)))
            t = parts[-1][1]
        end = t + 1
        spans.append((i, 0, 0, " ".join(tokens), 0.5, end))
        voiced += [(i, s, e) for s, e in parts]
        want[i] = spread_by_hand(tokens, parts or [(0.5, end)])
    df = spark.createDataFrame(spans, "item_id long, window int, seg int, text string, start double, end double")
    v = spark.createDataFrame(voiced, "item_id long, start double, end double")
    got = {}
    for r in tk.spread_over_speech(df, v).orderBy("item_id", "pos").collect():
        got.setdefault(r.item_id, []).append((r.text, r.start, r.end))
    for i, rows in want.items():
        assert [x[0] for x in got[i]] == [x[0] for x in rows]
        for (_, s, e), (_, ws, we) in zip(got[i], rows):
            # Sums of weights are exact here and rounded there, so a word on a border may move by a rounding error.
            assert abs(s - ws) < 1e-6 or any(abs(s - b) < 1e-6 for p in voiced for b in p[1:]) and abs(e - we) < 1e-6


def test_segment_spans_and_stream_clock(spark):
    rows = [(1, 0, 0, 1.0, 2.0, "a", 10.0, 100.0), (1, 0, 1, 4.0, 0.0, "b", 10.0, 100.0), (1, 0, 2, 7.0, 9.0, "c", 10.0, 100.0)]
    df = spark.createDataFrame(rows, "item_id long, window int, seg int, start double, duration double, text string, window_len double, offset double")
    assert [(r.start, r.end) for r in tk.segment_spans(df).orderBy("seg").collect()] == [(101.0, 103.0), (104.0, 107.0), (107.0, 110.0)]
    clips = spark.createDataFrame([(1, 5.0, 6.0), (1, 9.0, 11.0)], "item_id long, start double, end double")
    clock = tk.stream_clock(clips)
    times = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.5), (1, 99.0)], "item_id long, t double")
    assert sorted(r.t for r in tk.restore_times(times, clock, "t").collect()) == [5.5, 9.0, 10.5, 11.0]


def test_parts(spark):
    rows = [("f", "a.avi", "2024-01-01 10:00:00", 600.0), ("f", "b.avi", "2024-01-01 10:09:59", 600.0), ("f", "c.avi", "2024-01-01 10:20:00", 60.0),
            ("f", "d.avi", "2024-01-01 11:00:00", 60.0), ("f", "e.wav", None, None)]
    files = spark.createDataFrame(rows, "folder string, name string, s string, duration_s double").withColumn("start_utc", F.to_timestamp("s")).drop("s")
    got = {r.name: (r.chain, r.part, r.offset_s) for r in ct.group_parts(files).collect()}
    assert got == {"a.avi": ("a.avi", 0, 0.0), "b.avi": ("a.avi", 1, 599.0), "c.avi": ("a.avi", 2, 1200.0), "d.avi": ("d.avi", 0, 0.0), "e.wav": ("e.wav", 0, 0.0)}
    assert {r.chain: r.n_parts for r in ct.recordings(ct.group_parts(files)).collect()} == {"a.avi": 3, "d.avi": 1, "e.wav": 1}


def test_selection_and_patterns(spark):
    names = [(f"p/{s}/{c}/{s}-{c}-{i:04d}.flac",) for s, c in ((1, 9), (2, 3), (3, 1)) for i in range(3)] + [("p/1/9/1-9.trans.txt",)]
    picked = ct.chapter_selection(spark.createDataFrame(names, "name string"), "p/", 2, 2)
    assert sorted(r.target for r in picked.collect()) == sorted(
        ["utterances/1-9-0000.flac", "utterances/1-9-0001.flac", "utterances/2-3-0000.flac", "utterances/2-3-0001.flac", "utterances/1-9.trans.txt", "utterances/2-3.trans.txt"]
    )
    items = spark.createDataFrame([("hvb/1",), ("ami/x",), ("ami/y",)], "item_id string")
    assert [r[0] for r in ct.select_items(items, ["hvb/*", "ami/[!x]"]).orderBy("item_id").collect()] == ["ami/y", "hvb/1"]
    assert ct.select_items(items, None).count() == 3


def test_outputs_present_and_run_totals(spark):
    history = spark.createDataFrame([("a", {"t": "x", "s": "y"}), ("b", {"t": "z"})], "path string, outputs map<string,string>")
    files = spark.createDataFrame([("x",), ("z",)], "path string")
    assert {r.path: r.present for r in ct.outputs_present(history, files).collect()} == {"a": False, "b": True}
    engines = spark.createDataFrame([(1, 0, 1.0, 2.0, 9.0, {"np": "1", "k": "a"}), (1, 1, 1.0, 3.0, 9.0, {"np": "2"})], "item_id long, place int, load_s double, transcribe_s double, audio_s double, versions map<string,string>")
    row = ct.run_totals(engines).first()
    assert (row.load_s, row.transcribe_s, row.versions) == (2.0, 5.0, {"k": "a", "np": "2"})


def test_documents_round_trip_and_export(spark, tmp_path):
    docs = document(spark)
    fl.write_documents(docs, str(tmp_path / "docs"))
    good, bad = fl.load_documents(spark, str(tmp_path / "docs"), "s")
    assert good.count() == 1 and bad.count() == 0 and good.first().lines[0].words[0].w == "one"
    none, rejected = fl.load_documents(spark, str(tmp_path / "docs"))
    assert none.count() == 0 and "not a" in rejected.first().reason
    report = {r.format: r for r in fl.export_outputs(docs, str(tmp_path / "out"), "call", ["text", "srt", "vtt", "transcript"]).collect()}
    assert all(r.written for r in report.values()) and set(report) == {"text", "srt", "vtt", "transcript"}
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "call.text" / "item_id=1")).collect())
    assert text.startswith("call.wav\nDuration 0:20   |   2 speakers") and "[0:14.0] Speaker 2: six" in text
    assert "Review list: 3 spans where speech may be missing, 15.0% of the recording; see call.review.json." in text
    with pytest.raises(KeyError):
        fl.export_outputs(docs, str(tmp_path), "x", ["docx2"])
    with pytest.raises(ValueError):
        fl.export_outputs(docs, str(tmp_path), " ", ["srt"])
    facts = dc.document_facts(docs)
    assert (facts.first().speakers, facts.first().marks) == (2, 3)
    files = spark.createDataFrame([("f", "call.wav", 1), ("g", "call.wav", 5), ("h", "call.wav", None)], "folder string, name string, bytes long")
    assert sorted(r.folder for r in dc.document_is_for(facts, files).collect()) == ["f", "h"]


def test_sessions_history_lock_round_trip(spark, tmp_path):
    marks = dc.marks_of(document(spark)).select("item_id", "mark", "start", "end")
    session = decide(spark, [("text", "x", None), ("open", "", None), ("nothing", "", None)]).join(marks, ["item_id", "mark"])
    fl.write_sessions(session, str(tmp_path / "s"))
    back = fl.load_sessions(spark, str(tmp_path / "s"))
    assert [(r.mark, r.status) for r in back.orderBy("mark").collect()] == [(0, "text"), (1, "open"), (2, "nothing")]
    (tmp_path / "h.json").write_text(json.dumps({"schema": "spanloom.history.v1", "entries": [{"path": "/a/b.wav"}, {"name": "none"}]}))
    assert [r.name for r in fl.read_history(spark, str(tmp_path / "h.json")).collect()] == ["b.wav"]
    assert fl.read_history(spark, str(tmp_path / "h.json"), "other").count() == 0
    lock = spark.createDataFrame([("k", "d/f", "00", 3)], "key string, file string, sha256 string, bytes long")
    fl.write_lock(lock, str(tmp_path / "lock"))
    assert tuple(fl.read_lock(spark, str(tmp_path / "lock")).select("key", "file", "sha256", "bytes").first()) == ("k", "d/f", "00", 3)
    (tmp_path / "inv").mkdir()
    (tmp_path / "inv" / "x.bin").write_bytes(b"abc")
    row = fl.inventory(spark, str(tmp_path / "inv"), digests=True).first()
    assert (row.name, row.bytes, row.sha256[:8]) == ("x.bin", 3, "ba7816bf")
    (tmp_path / "a.run.json").write_text(json.dumps({"input_path": "/r/a.wav"}))
    assert tuple(fl.recorded_source(spark, str(tmp_path / "a.run.json")).first()) == ("a", "/r/a.wav")


def test_append_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "item_id long, v string")
    fl.append_missing(one, path, ["item_id"])
    fl.append_missing(spark.createDataFrame([(1, "b"), (2, "c")], "item_id long, v string"), path, ["item_id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_peaks_match_numpy_edges(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for n, bins in ((1000, 7), (5, 12), (1201, 1200), (999, 50)):
        x = rng.normal(size=n).astype(np.float32)
        edges = np.linspace(0, n, bins + 1, dtype=np.int64)
        top = float(np.abs(x).max())
        want = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            v = np.abs(x[lo:hi]).max() if hi > lo else np.float32(0)
            want.append(int(round(float(np.float32(100) * np.float32(v) / np.float32(top)))))
        s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "item_id long, idx long, value double")
        items = spark.createDataFrame([(1,)], "item_id long")
        assert [r.peak for r in se.overview_peaks(s, items, bins).orderBy("bin").collect()] == want
