"""Attribution and scenes: hand fixtures and random cases against a plain restatement."""

import random

from pyspark.sql import functions as F

from spanloom.config import LabelSettings
from spanloom.operators import labels as lb
from spanloom.operators import scenes as sc


def smooth_by_hand(words, min_words, min_s):
    """words: list of [start, end, label] of one utterance"""
    labels, changed = [w[2] for w in words], set()
    while True:
        runs = []
        for i, label in enumerate(labels):
            if runs and labels[runs[-1][0]] == label:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for k in range(1, len(runs) - 1):
            a, b = runs[k]
            left, right = labels[runs[k - 1][0]], labels[runs[k + 1][0]]
            if left == right and b - a + 1 < min_words and words[b][1] - words[a][0] < min_s:
                for i in range(a, b + 1):
                    labels[i] = left
                    changed.add(i)
                break
        else:
            return labels, changed


def test_smoothing_at_random(spark):
    rng = random.Random(9)
    rows, segments, texts = [], [], {}
    for u in range(60):
        t, mine = 1000.0 * u, []
        for _ in range(rng.randrange(1, 25)):
            d = rng.choice([0.2, 0.3, 0.7])
            mine.append([round(t, 3), round(t + d, 3), rng.choice("ab") if rng.random() < 0.9 else None])
            t += d
        segments.append((1, 1000.0 * u, t + 1))
        texts[u] = mine
        rows += [(1, u * 1000 + i, s, e, l) for i, (s, e, l) in enumerate(mine)]
    rows.append((1, 999999, 999.0 * 1000, 999.0 * 1000 + 1, "z"))
    words = spark.createDataFrame(rows, "item_id long, seq long, start double, end double, label string")
    segs = spark.createDataFrame(segments, "item_id long, start double, end double")
    for settings in (LabelSettings(), LabelSettings(min_run_words=3), LabelSettings(min_run_words=6, min_run_s=2.0)):
        got = {r.seq: (r.label, r.relabelled) for r in lb.smooth_labels(words, segs, settings).collect()}
        assert len(got) == len(rows) and got[999999] == ("z", False)
        for u, mine in texts.items():
            labels, changed = smooth_by_hand(mine, settings.min_run_words, settings.min_run_s)
            assert [got[u * 1000 + i][0] for i in range(len(mine))] == labels
            # A word whose run gave way more than once may end on its own label; that is no relabelling
            # of the reader's, so only the labels and the untouched words are compared.
            assert all(not got[u * 1000 + i][1] for i in range(len(mine)) if i not in changed)


def test_words_without_turns_stay_unlabelled(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 1.0, "a"), (2, 0, 0.0, 1.0, "b"), (2, 1, 9.0, 9.5, "c")], "item_id long, seq long, start double, end double, text string")
    turns = spark.createDataFrame([(2, 1.5, 3.0, "spk")], "item_id long, start double, end double, label string")
    got = {(r.item_id, r.seq): r.label for r in lb.label_words(words, turns).collect()}
    assert got == {(1, 0): None, (2, 0): "spk", (2, 1): "spk"}


def test_lines_break_on_speaker_pause_and_length(spark):
    rows = [(1, i, i * 0.5, i * 0.5 + 0.4, f"w{i}", "a") for i in range(130)] + [(1, 200, 70.0, 70.5, "late", "a"), (1, 201, 70.5, 71.0, "b", "b")]
    words = spark.createDataFrame(rows, "item_id long, seq long, start double, end double, text string, label string")
    lines = lb.build_lines(words).orderBy("start").collect()
    assert [(l.speaker, len(l.words)) for l in lines] == [("a", 60), ("a", 60), ("a", 10), ("a", 1), ("b", 1)]


def test_fold_small_labels(spark):
    turns = spark.createDataFrame([(1, 0.0, 10.0, "x"), (1, 10.0, 20.0, "y"), (1, 20.0, 21.0, "z"), (2, 0.0, 1.0, "q")], "item_id long, start double, end double, label string")
    vectors = spark.createDataFrame([(1, "x", [1.0, 0.0]), (1, "y", [0.0, 1.0]), (1, "z", [0.1, 0.9]), (2, "q", [1.0, 0.0])], "item_id long, label string, vec array<double>")
    got = sorted((r.item_id, r.start, r.label) for r in lb.fold_small_labels(turns, vectors).collect())
    assert got == [(1, 0.0, "speaker_00"), (1, 10.0, "speaker_01"), (1, 20.0, "speaker_01"), (2, 0.0, "q")]


def scenes_by_hand(scenes, join):
    out = []
    for s, e, kind, label, p in sorted(scenes, key=lambda x: (x[0], x[1])):
        if out and out[-1][2] == kind and s <= out[-1][1] + join:
            last = out[-1]
            keep = last[1] - last[0] >= e - s
            out[-1] = (last[0], max(last[1], e), kind, last[3] if keep else label, max(last[4], p))
        else:
            out.append((s, e, kind, label, p))
    return out


def test_merge_scenes_at_random(spark):
    rng = random.Random(7)
    rows, want = [], []
    for item in range(15):
        t, mine = 0.0, []
        for _ in range(25):
            d = rng.choice([1.0, 2.0, 400.0])
            mine.append((t, t + d, rng.choice(["music", "noise"]), rng.choice(["", "x", "y"]), rng.random()))
            t += d + rng.choice([-0.5, 0.0, 0.04, 3.0])
        rows += [(item, *m) for m in mine]
        want += [(item, *m) for m in scenes_by_hand(mine, 0.05)]
    df = spark.createDataFrame(rows, "item_id int, start double, end double, kind string, label string, probability double")
    got = sc.merge_scenes(df).collect()
    assert sorted((r.item_id, r.start, r.end, r.kind, r.label, r.probability) for r in got) == sorted(want)


def test_scene_pass(spark):
    """A minute: silence, speech, tagged music, an utterance that is music, silence."""
    rate = 10
    loud = [(5, 10), (10, 26), (26, 36), (45, 50)]
    samples = [(1, i, 0.1 if any(a * rate <= i < b * rate for a, b in loud) else 0.0) for i in range(60 * rate)]
    utterances = [(1, 5.0, 10.0, "one two", 2), (1, 26.0, 31.5, "three four", 2), (1, 31.5, 36.0, "la la la la", 4), (1, 45.0, 50.0, "five", 1)]
    s = spark.createDataFrame(samples, "item_id long, idx long, value double")
    u = spark.createDataFrame(utterances, "item_id long, start double, end double, text string, words int")
    items = spark.createDataFrame([(1, 60.0)], "item_id long, audio_s double")
    asked = sc.regions(u, items)

    def tagger(batch):
        music = lambda r: (r.start >= 10 and r.end <= 26) or r.start == 31.5
        return [[("Music", 0.9)] if music(r) else [("Speech", 0.9)] for r in batch.itertuples()]

    scenes, suppressed = sc.analyse(s, u, items, sc.tag_regions(asked, tagger), rate=rate)
    got = [(r.start, r.end, r.kind) for r in scenes.orderBy("start").collect()]
    assert got == [(0.0, 5.0, "silence"), (10.0, 26.0, "music"), (31.5, 36.0, "music"), (36.0, 45.0, "silence"), (50.0, 60.0, "silence")]
    assert [r.text for r in suppressed.collect()] == ["la la la la"]
    totals = {r.kind: r.seconds for r in sc.seconds_by_kind(scenes).collect()}
    assert totals == {"silence": 24.0, "music": 20.5}
    plain, none = sc.analyse(s, u, items, None, rate=rate)
    assert {r.kind for r in plain.collect()} == {"silence", "sound"} and none.count() == 0


def test_windows(spark):
    spans = spark.createDataFrame([(1, 0.0, 25.0), (1, 30.0, 40.0)], "item_id long, start double, end double")
    got = [(r.start, r.end) for r in sc.split_windows(spans, 10.0).orderBy("start").collect()]
    assert len(got) == 4 and got[2][1] == 25.0 and abs(got[0][1] - 25 / 3) < 1e-12 and got[3] == (30.0, 40.0)
    cut = sc.pieces(spark.createDataFrame([(0, 25), (5, 5)], "lo long, hi long"), 10)
    assert [(r.piece_lo, r.piece_hi) for r in cut.orderBy("piece").collect()] == [(0, 8), (8, 17), (17, 25)]
