"""Wording, cues, documents and edits on hand fixtures."""

from pyspark.sql import functions as F

from spanloom.functions import wording as wd
from spanloom.operators import cues as cu
from spanloom.operators import documents as dc
from spanloom.operators import edits as ed


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_times(spark):
    assert values(spark, [0.0, 59.96, 3599.96, 3723.45, -1.0], "x double", wd.clock("x")) == ["0:00.0", "1:00.0", "1:00:00.0", "1:02:03.4", "0:00.0"]
    assert values(spark, [3723.4], "x double", wd.minutes_clock("x")) == ["62:03.4"]
    assert values(spark, [3661.5], "x double", wd.cue_time("x", ",")) == ["01:01:01,500"]
    assert values(spark, [45.2, 60.0, 150.0], "x double", wd.format_seconds("x")) == ["45 s", "1 min", "2 min 30 s"]


def test_split_rows(spark):
    long = "the quick brown fox jumps over the lazy dog again and again"
    got = values(spark, ["short", long, "x" * 50], "x string", wd.split_rows("x"))
    cut = min((i for i, c in enumerate(long) if c == " "), key=lambda i: abs(i - len(long) // 2))
    assert got == ["short", long[:cut] + "\n" + long[cut + 1 :], "x" * 50]


def test_paths(spark):
    assert values(spark, ["/a//b/../c/./d", "a/../../b", "/.."], "x string", wd.canonical_path("x")) == ["/a/c/d", "../b", "/"]
    df = spark.createDataFrame([("/a/b/c.wav", "/a/b/../b/c.wav"), ("b/c.wav", "/a/b/c.wav"), ("x/c.wav", "/a/b/c.wav")], "a string, b string")
    assert [r[0] for r in df.select(wd.same_recording("a", "b")).collect()] == [True, True, False]
    assert values(spark, ["/x/call.review.json"], "x string", wd.sibling("x", ".review.json", ".transcript.json")) == ["/x/call.transcript.json"]


def word(s, e, w, src=None, mark=None):
    return (s, e, w, src, mark)


def document(spark):
    lines = [
        (0.0, 3.0, "a", "one two three", None, None, [word(0.0, 1.0, "one"), word(1.0, 2.0, "two"), word(2.0, 3.0, "three")]),
        (6.0, 12.0, "a", "four five", None, None, [word(6.0, 7.0, "four"), word(11.0, 12.0, "five")]),
        (14.0, 15.0, "b", "six", None, None, [word(14.0, 15.0, "six")]),
    ]
    marks = [(2.6, 6.4, 3.0, 6.0, 2, None), (6.6, 11.4, 7.0, 11.0, 2, None), (11.6, 14.4, 12.0, 14.0, 2, None)]
    speakers = [("a", "Speaker 1", 5, 9.0), ("b", "Speaker 2", 1, 1.0)]
    row = (1, "s", ("call.wav", "d", 1, "call", None), 20.0, "t", "p", speakers, lines, marks, (3, 3.0, 0.15), [(16.0, 20.0, "music", "", 0.5)], None)
    return spark.createDataFrame([row], "item_id long, " + dc.DOCUMENT)


def decide(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "item_id long, mark int, status string, note string, speaker string")


def shape(docs):
    row = docs.first()
    return [(l.speaker, l.text, l.src) for l in row.lines], row


def test_words_go_where_the_gap_is(spark):
    doc = document(spark)
    out = ed.apply_resolutions(doc, decide(spark, [("text", "x y", None), ("text", "in side", None), ("nothing", "", None)]))
    lines, row = shape(out)
    assert lines == [("a", "one two three x y", None), ("a", "four in side five", None), ("b", "six", None)]
    assert row.review_applied.asDict() == {"text": 2, "nothing": 1, "open": 0, "listener_words": 4}
    assert row.marks[0].resolution.speaker == "a" and row.marks[2].resolution.status == "nothing"
    assert row.speakers[0].words == 9
    again, row2 = shape(ed.apply_resolutions(out, decide(spark, [("text", "x y", None), ("text", "in side", None), ("nothing", "", None)])))
    assert again == lines and row2.speakers == row.speakers
    reopened, row3 = shape(ed.apply_resolutions(out, decide(spark, [("open", "", None)] * 3)))
    assert reopened == shape(doc)[0] and row3.review_applied.open == 3 and row3.speakers[0].words == 5


def test_another_speaker_splits_the_line_and_it_is_joined_again(spark):
    doc = document(spark)
    out = ed.apply_resolutions(doc, decide(spark, [("open", "", None), ("text", "new voice", "c"), ("text", "mid", None)]))
    lines, row = shape(out)
    assert lines == [("a", "one two three", None), ("a", "four", None), ("c", "new voice", "listener"), ("a", "five", None), (None, "mid", "listener"), ("b", "six", None)]
    assert [s.label for s in row.speakers] == ["a", "b", "c", None]
    joined, _ = shape(ed.strip_listener(out))
    assert joined == shape(doc)[0]
    assert [(r.mark, r.line) for r in ed.listener_line_for(out).orderBy("mark").collect()] == [(1, 2), (2, 4)]
    texts = [r.value for r in dc.transcript_lines(out).orderBy("at").collect()]
    assert "[0:07.0] c: {new voice}" in texts and texts[-1] == "[0:16.0] (music, no speech, 4 s)" and texts[-2] == ""


def test_merge_and_rename(spark):
    doc = document(spark)
    row = dc.merge_speakers(doc, "b", "a").first()
    assert [(s.label, s.words) for s in row.speakers] == [("a", 6)]
    names = spark.createDataFrame([(1, "b", "  Mary   Ann ")], "item_id long, label string, name string")
    assert dc.set_speaker_name(doc, names).first().speakers[1].name == "Mary Ann"


def test_cues(spark):
    doc = document(spark)
    cues = cu.build_cues(dc.lines_of(doc), dc.scenes_of(doc), dc.speaker_names(doc)).orderBy("cue").collect()
    assert [(c.start, c.end, c.text) for c in cues] == [
        (0.0, 3.0, "Speaker 1: one two three"), (6.0, 12.0, "Speaker 1: four five"), (14.0, 15.0, "Speaker 2: six"), (16.0, 20.0, "[music]"),
    ]
    assert cu.srt_blocks(cu.build_cues(dc.lines_of(doc), dc.scenes_of(doc), dc.speaker_names(doc))).orderBy("at").first().value == (
        "1\n00:00:00,000 --> 00:00:03,000\nSpeaker 1: one two three\n"
    )


def chunks_by_hand(words, prefix, max_chars, max_s):
    size = lambda ws: prefix + sum(len(w[2]) + 1 for w in ws) - 1
    if len(words) <= 1 or (size(words) <= max_chars and words[-1][1] - words[0][0] <= max_s):
        return [words]
    total = sum(len(w[2]) + 1 for w in words)
    best = min(range(1, len(words)), key=lambda i: abs(sum(len(w[2]) + 1 for w in words[:i]) - total / 2))
    return chunks_by_hand(words[:best], prefix, max_chars, max_s) + chunks_by_hand(words[best:], prefix, max_chars, max_s)


def test_balanced_chunks(spark):
    import random

    rng = random.Random(3)
    rows = []
    for n in (1, 2, 5, 17, 60, 60, 40):
        t, words = 0.0, []
        for _ in range(n):
            d = rng.uniform(0.1, 0.9)
            words.append(word(t, t + d, "w" * (200 if rng.random() < 0.05 else rng.randrange(1, 12))))
            t += d
        rows.append((len(rows), "Speaker 1: ", words))
    df = spark.createDataFrame(rows, f"item_id int, prefix string, words array<{dc.WORD}>")
    for r in cu.balanced_chunks(df).collect():
        want = chunks_by_hand(rows[r.item_id][2], 11, 84, 7.0)
        assert [[w.w for w in c] for c in r.chunks] == [[w[2] for w in c] for c in want]


def test_chunks_of_unknown_times(spark):
    """Words without times are halved in seven passes; one chunk that is too long takes the line further."""
    rows = [
        (0, "a: ", [word(None, None, "ab")] * 60), (1, "a: ", [word(None, None, "ab")] * 300), (2, "a: ", [word(None, None, "ab"), word(1.0, 2.0, " ")]),
        (3, "a: ", [word(None, None, "x" * 40)] * 300), (4, "a: ", [word(0.0, 1.0, " ")]), (5, "a: ", []),
        (6, None, [word(0.0, 1.0, "ab")] * 3),
    ]
    df = spark.createDataFrame(rows, f"item_id int, prefix string, words array<{dc.WORD}>")
    got = {r.item_id: [len(c) for c in r.chunks] for r in cu.balanced_chunks(df).collect()}
    assert got == {0: [1] * 60, 1: got[1], 2: [1], 3: [1] * 300, 6: [1] * 3}
    assert len(got[1]) == 128 and sum(got[1]) == 300


def test_cues_are_cut_once(spark):
    """The scan over the cues reads a settled table: it reads its input twice, and cutting lines is the dear part."""
    doc = document(spark)
    cues = cu.build_cues(dc.lines_of(doc), dc.scenes_of(doc), dc.speaker_names(doc))
    plan = cues._jdf.queryExecution().optimizedPlan().toString()
    assert "chunks" not in plan and "lambda" not in plan
    lines = dc.lines_of(doc).withColumn("prefix", F.lit("a: "))
    chunks = cu.balanced_chunks(lines).select(F.explode_outer("chunks").alias("c"))
    assert chunks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_split_rows_takes_the_first_of_two_spaces(spark):
    texts = ["a" * 20 + " " + "b" * 3 + " " + "c" * 20, "é" * 50 + " b", "a " + "b" * 50, "a" * 10 + "  " + "b" * 40, "x" * 43, "a" * 21 + " " + "b" * 21]
    assert values(spark, texts, "x string", wd.split_rows("x")) == [
        "a" * 20 + "\n" + "bbb " + "c" * 20, "é" * 50 + "\nb", "a\n" + "b" * 50, "a" * 10 + "\n" + "b" * 40, "x" * 43, "a" * 21 + "\n" + "b" * 21,
    ]


def test_sessions(spark):
    marks = dc.marks_of(document(spark))
    short = decide(spark, [("open", "", None)] * 2)
    assert ed.valid_sessions(short, marks).count() == 0
    odd = decide(spark, [("strange", None, None)] * 3)
    assert [(r.status, r.note) for r in ed.valid_sessions(odd, marks).collect()] == [("open", "")] * 3


def test_gap_context(spark):
    words = spark.createDataFrame([(1, i, float(i), i + 1.0, f"w{i}", "a" if i < 3 else None) for i in range(40)], "item_id long, seq long, start double, end double, text string, label string")
    marks = spark.createDataFrame([(1, 0, 20.0), (1, 1, 2.0)], "item_id long, mark int, span_start double")
    got = {r.mark: r.context for r in dc.gap_context(marks, words).collect()}
    assert got[0] == "... " + " ".join(f"w{i}" for i in range(6, 20)) + " [ GAP ] " + " ".join(f"w{i}" for i in range(20, 34)) + " ..."
    assert got[1].startswith("w0 w1 [ GAP ] w2 w3")
    names = spark.createDataFrame([(1, "a", "Ann")], "item_id long, speaker string, name string")
    named = {r.mark: r.context for r in dc.gap_context(marks, words, names).collect()}
    assert named[1].startswith("Ann: w0 w1 [ GAP ] Ann: w2 Unknown speaker: w3 w4")
