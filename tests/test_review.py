"""Interval and review operators: hand fixtures, random cases against a plain restatement."""

import random

import pytest

from spanloom.config import ReviewSettings
from spanloom.operators import intervals as iv
from spanloom.operators import review as rv
from spanloom.operators.scans import Scan, as_of, bucketed_scan, time_bucket

from pyspark.sql import Window
from pyspark.sql import functions as F


def words(spark, rows, item=1):
    """rows: (text, start, end) or (item, text, start, end)"""
    full = [(r if len(r) == 4 else (item, *r)) for r in rows]
    return spark.createDataFrame([(i, n, t, float(s), float(e)) for n, (i, t, s, e) in enumerate(full)], "item_id long, seq long, text string, start double, end double")


def items(spark, *rows):
    return spark.createDataFrame([(i, float(a)) for i, a in rows], "item_id long, audio_s double")


def marks_of(df):
    return [(r.item_id, round(r.span_start, 6), round(r.span_end, 6), r.detector_words, r.detector_text) for r in df.orderBy("item_id", "span_start").collect()]


def test_scans_agree_with_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), float(rng.randrange(4000)), n, None if rng.random() < 0.6 else rng.randrange(100)) for n in range(600)]
    df = spark.createDataFrame(rows, "k int, t double, n int, v int")
    scans = [Scan("mx", "max_before", F.col("v")), Scan("sm", "sum_before", F.col("v")), Scan("lb", "last_before", F.col("v")),
             Scan("fa", "first_after", F.col("v")), Scan("lg", "lag", F.col("v")), Scan("ld", "lead", F.col("v"))]
    got = bucketed_scan(df, ["k"], time_bucket("t", 100.0), ["t", "n"], scans)
    w = Window.partitionBy("k").orderBy("t", "n")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.withColumns({
        "mx": F.max("v").over(before), "sm": F.coalesce(F.sum("v").over(before), F.lit(0)), "lb": F.last("v", True).over(before),
        "fa": F.first("v", True).over(after), "lg": F.lag("v").over(w), "ld": F.lead("v").over(w),
    })
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_basic_mark(spark):
    published = words(spark, [("a", 0, 1), ("b", 1, 2), ("c", 4, 5), ("d", 9, 10)])
    detector = words(spark, [("x", 2.5, 2.8), ("y", 3.0, 3.3), ("z", 6.0, 6.5)])
    row = rv.build_review(published, detector, items(spark, (1, 10))).collect()
    assert [(r.span_start, r.span_end, round(r.start, 6), r.end, r.detector_words, r.detector_text, r.mark) for r in row] == [(2.0, 4.0, 1.6, 4.4, 2, "x y", 0)]


def test_thresholds_edges_and_empty_sides(spark):
    published = words(spark, [(1, "a", 0, 2), (1, "b", 6, 10), (2, "a", 0, 1), (2, "b", 1.8, 3), (4, "a", 1, 2)])
    detector = words(spark, [(1, "z", 3, 3.5), (2, "p", 1.1, 1.3), (2, "q", 1.4, 1.6), (3, "u", 1, 2), (3, "v", 3, 4), (4, "h", 0.1, 0.3), (4, "i", 0.4, 0.6), (4, "j", 2.5, 2.7), (4, "k", 2.8, 3.0)])
    all_items = items(spark, (1, 10), (2, 3), (3, 5), (4, 4), (5, 0))
    assert marks_of(rv.build_review(published, detector, all_items)) == [
        (2, 1.0, 1.8, 2, "p q"), (3, 0.0, 5.0, 2, "u v"), (4, 0.0, 1.0, 2, "h i"), (4, 2.0, 4.0, 2, "j k"),
    ]
    one = marks_of(rv.build_review(published, detector, all_items, ReviewSettings(min_detector_words=1)))
    assert (1, 2.0, 6.0, 1, "z") in one
    zero = marks_of(rv.build_review(published, detector, all_items, ReviewSettings(min_detector_words=0)))
    assert (1, 2.0, 6.0, 1, "z") in zero and len(zero) == 5
    with pytest.raises(ValueError):
        ReviewSettings(pad_s=-1)


def test_echoes(spark):
    published = words(spark, [("so", 0, 1), ("Hello,", 1, 2), ("world", 6, 7)])
    echo = words(spark, [("hello", 2.1, 2.3), ("world", 5.5, 5.8), ("there", 3, 3.2)])
    assert marks_of(rv.build_review(published, echo, items(spark, (1, 7)))) == []
    said_twice = words(spark, [("hello", 1.1, 1.9), ("hello", 2.1, 2.3), ("there", 3, 3.2)])
    assert marks_of(rv.build_review(published, said_twice, items(spark, (1, 7)))) == [(1, 2.0, 6.0, 2, "hello there")]


def naive_echoes(w, b, a, db, da):
    w, head, tail = list(w), 0, 0
    for c in range(min(len(w), len(b)), 0, -1):
        if all(w[:c]) and w[:c] == b[-c:]:
            head = 0 if db[-c:] == w[:c] else c
            break
    w = w[head:]
    for c in range(min(len(w), len(a)), 0, -1):
        if all(w[-c:]) and w[-c:] == a[:c]:
            tail = 0 if da[:c] == w[-c:] else c
            break
    return w[: len(w) - tail]


def test_echoes_at_random(spark):
    rng = random.Random(11)
    some = lambda lo, hi: [rng.choice(["x", "y", ""]) for _ in range(rng.randrange(lo, hi))]
    rows = []
    for i in range(400):
        w = some(1, 6)
        rows.append((i, w, *[some(0, len(w) + 1) for _ in range(4)]))
    df = spark.createDataFrame(rows, "i int, n array<string>, before array<string>, after array<string>, d_before array<string>, d_after array<string>")
    df = df.withColumn("words", F.transform("n", lambda n, p: F.struct(p.alias("p"), n.alias("norm")))).drop("n")
    for r in rv.echoes_removed(df).collect():
        _, w, b, a, db, da = rows[r.i]
        assert [x.norm for x in r.words] == naive_echoes(w, b, a, db, da), rows[r.i]


def test_evaluation(spark):
    reference = words(spark, [("r", 1, 2), ("r", 3, 4), ("r", 6, 7), ("r", 10, 11), ("r", 15, 16)])
    published = words(spark, [("p", 1, 2), ("p", 3.5, 4.5)])
    marks = spark.createDataFrame([(1, 0, 4.6, 8.4, 5.0, 8.0), (1, 1, 11.6, 13.4, 12.0, 13.0), (1, 2, 14.1, 17.4, 14.5, 17.0)], "item_id long, mark long, start double, end double, span_start double, span_end double")
    evaluated = rv.evaluate_review(marks, published, reference, items(spark, (1, 20)))
    r = evaluated.first()
    assert (r.marks, r.marks_on_speech, r.dropped_words, r.dropped_covered) == (3, 2, 3, 2)
    assert abs(r.audio_to_review_s - 8.9) < 1e-9 and abs(r.audio_to_review_fraction - 0.445) < 1e-9
    assert rv.summary_text(evaluated).first().summary == "3 marks covering 44.5% of the recording; 2 of 3 on real speech; marks cover 67% of dropped words (2 of 3)"


def naive_spans(rows, audio):
    cursor, out = 0.0, []
    for s, e in sorted((max(0.0, s), min(audio, e)) for s, e in rows):
        if e <= s:
            continue
        if s > cursor:
            out.append((cursor, s))
        cursor = max(cursor, e)
    return out + ([(cursor, audio)] if audio > cursor else [])


def test_silent_spans_and_union_at_random(spark):
    rng = random.Random(2)
    rows, want, merged = [], [], []
    for item in range(20):
        audio, mine = rng.choice([30.0, 2500.0]), []
        for _ in range(rng.randrange(40)):
            s = round(rng.uniform(-5, audio + 5), 1)
            mine.append((s, round(s + rng.choice([0, 0.3, 2, 700]), 1)))
        rows += [(item, "w", s, e) for s, e in mine]
        want += [(item, s, e) for s, e in naive_spans(mine, audio)]
        islands = []
        for s, e in sorted(x for x in mine if x[1] > x[0]):
            if islands and s <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], e)
            else:
                islands.append([s, e])
        merged += [(item, s, e) for s, e in islands]
        rows.append((item, "end", audio + 100, audio + 100))
        items_rows = [(i, 0.0) for i in range(20)]
    ends = {i: None for i in range(20)}
    for item, text, s, _ in rows:
        if text == "end":
            ends[item] = s - 100
    got = rv.silent_spans(words(spark, [r for r in rows if r[1] == "w"]), items(spark, *ends.items()))
    assert sorted((r.item_id, r.start, r.end) for r in got.collect()) == sorted(want)
    union = iv.union_spans(words(spark, [r for r in rows if r[1] == "w"]))
    assert sorted((r.item_id, r.start, r.end) for r in union.collect()) == sorted(merged)


def test_overlap_join_at_random(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.randrange(3), k, *(lambda s: (s, s + rng.choice([0.0, 0.5, 3.0, 45.0])))(float(rng.randrange(100)))) for k in range(n)]
    left, right = make(80), make(80)
    a = spark.createDataFrame(left, "item_id int, l int, start double, end double")
    b = spark.createDataFrame(right, "item_id int, r int, r_start double, r_end double")
    want = sorted((x[0], x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.item_id, r.l, r.r) for r in iv.overlap_join(a, b).collect()) == want


def test_overlap_join_of_long_spans(spark):
    rng = random.Random(14)
    lengths = [0.0, 0.3, 79.9, 80.0, 80.1, 640.0, 641.0, 5120.0, 5e4, 2.6e6, 4e8]
    make = lambda n: [(rng.randrange(3), k, *(lambda s: (s, s + rng.choice(lengths)))(float(rng.randrange(-9000, 4_000_000) // 40 * 40)) ) for k in range(n)]
    for left, right in ((make(150), make(150)), (make(150), [(i, k, s, s + 0.5) for i, k, s, _ in make(150)])):
        a = spark.createDataFrame([*left, (0, -1, None, 5.0), (0, -2, 9.0, 3.0)], "item_id int, l int, start double, end double")
        b = spark.createDataFrame([*right, (None, -1, 0.0, 9e9)], "item_id int, r int, r_start double, r_end double")
        want = sorted((x[0], x[1], y[1]) for x in [*left, (0, -2, 9.0, 3.0)] for y in right if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
        assert len(want) > 500
        for one, two in ((a, b), (a.repartition(3), b.repartition(5))):
            assert sorted((r.item_id, r.l, r.r) for r in iv.overlap_join(one, two).collect()) == want
        empty = b.where("false")
        assert iv.overlap_join(a, empty).count() == 0 and iv.overlap_join(a.where("false"), b).count() == 0


def test_a_span_of_a_month_is_a_few_rows(spark):
    month = spark.createDataFrame([(1, 3.0, 2_600_003.0)], "item_id int, start double, end double")
    words = spark.createDataFrame([(1, float(k), k + 0.4) for k in range(0, 2_700_000, 9000)], "item_id int, r_start double, r_end double")
    stored = iv.in_levels(month, ("start", "end"), iv.long_levels(words, ("r_start", "r_end"), 10.0), "own", 10.0)
    assert stored.select("__k", "__b").distinct().count() <= 2 and stored.count() <= 2 * iv.LEVEL_GROUPS
    probes = iv.in_levels(words, ("r_start", "r_end"), iv.long_levels(month, ("start", "end"), 10.0), "own", 10.0)
    assert probes.select("__k").distinct().count() == 2 and probes.select("__g").distinct().count() > 1
    assert iv.overlap_join(month, words).count() == sum(k < 2_600_003 and k + 0.4 > 3 for k in range(0, 2_700_000, 9000))


def test_as_of(spark):
    probes = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 5000.0)], "item_id long, t double")
    rows = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "b"), (1, 3.0, "c")], "item_id long, start double, v string")
    got = as_of(probes, rows, ["item_id"], "t", "start", F.col("v"), "hit", tie=F.col("v"))
    assert [(r.t, r.hit) for r in got.orderBy("t").collect()] == [(0.5, None), (1.0, "b"), (5000.0, "c")]


def borders_plainly(spans, published, detector):
    tol, out = rv.TOLERANCE, {}
    for item, s, e, n in spans:
        sides = []
        for source in (published, detector):
            mine = [w for w in source if w[0] == item]
            ended = [w for w in sorted(mine, key=lambda w: (w[3], w[2], w[4])) if w[3] <= s + tol]
            after = [w for w in sorted(mine, key=lambda w: (w[2], w[3], w[4])) if w[2] >= e - tol]
            sides += [[w[1] for w in ended[max(0, len(ended) - n):]], [w[1] for w in after[:n]]]
        if any(sides):
            out[(item, s, e)] = tuple(sides)
    return out


def test_border_words_come_from_blocks_of_buckets(spark, monkeypatch):
    """Also from buckets far away and over several position chunks; no table has a row a word."""
    rng = random.Random(8)
    sources = []
    for _ in range(2):
        rows = []
        for item in (1, 2):
            for seq in range(400):
                s = round(rng.choice([rng.uniform(0, 700), rng.uniform(3000, 9000), 1200.0]), 2)
                rows.append((item, "qz" + chr(97 + rng.randrange(26)) + "x", s, round(s + rng.choice([0.2, 0.4, 50.0]), 2), seq))
        sources.append(rows)
    spans = []
    for item in (1, 2, 3):
        for _ in range(25):
            s = round(rng.uniform(0, 9000), 2)
            spans.append((item, s, round(s + rng.uniform(1, 300), 2), rng.choice([1, 3, 40, 300])))
    schema = "item_id long, text string, start double, end double, seq long"
    p, d = (spark.createDataFrame(rows, schema) for rows in sources)
    asked = spark.createDataFrame(spans, "item_id long, span_start double, span_end double, n int")
    sizes, settle = [], rv.settle

    def counted(df):
        out = settle(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rv, "settle", counted)
    for chunk in (rv.CHUNK, 7):
        monkeypatch.setattr(rv, "CHUNK", chunk, raising=False)
        got = {(r.item_id, r.span_start, r.span_end): (r.before, r.after, r.d_before, r.d_after) for r in rv.border_words(asked, p, d).collect()}
        assert got == borders_plainly(spans, *sources)
    assert max(sizes) < 800


def test_evaluation_settles_what_it_reads_again(spark, monkeypatch):
    settled, settle = [], rv.settle
    monkeypatch.setattr(rv, "settle", lambda df: settled.append(df.columns) or settle(df))
    ref = words(spark, [("a", 0, 1), ("b", 4, 5), ("c", 8, 9)])
    marks = spark.createDataFrame([(1, 3.0, 6.0, 3.5, 5.5)], "item_id long, start double, end double, span_start double, span_end double")
    row = rv.evaluate_review(marks, words(spark, [("a", 0, 1)]), ref, items(spark, (1, 10))).collect()[0]
    assert (row.marks, row.marks_on_speech, row.dropped_words, row.dropped_covered, row.audio_to_review_s) == (1, 1, 2, 1, 3.0)
    assert sum("span_start" in c for c in settled) == 1 and sum("seq" in c for c in settled) == 1
