"""Streams drained with availableNow give what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import review as rv
from spanloom.streaming import live as lv
from spanloom.streaming import marks as mk


def feed(spark, folder, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None


def test_live_segments(spark, tmp_path):
    schema = "item_id string, role string, start double, end double, text string"
    stream = feed(spark, tmp_path / "in", [[("i", "publisher", 0.0, 1.0, "  a   b "), ("i", "detector", 0.0, 1.0, "x"), ("i", "publisher", 1.0, 2.0, " ")]], schema)
    drain(lv.live_segments(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a b"]


def test_progress_with_a_stall_between(spark, tmp_path):
    schema = "item_id string, stage string, fraction double, elapsed_s double, parallel boolean, at timestamp"
    second = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    rows = [
        [("i", "digest", 1.0, 1.0, False, second(1))],
        [("i", "publisher", 0.5, 10.0, True, second(10))],
        [("other", "digest", 0.5, 1.0, False, second(90))],  # the watermark passes i by more than 20 s
        [("other", "digest", 0.6, 2.0, False, second(95))],
        [("i", "detector", 0.5, 100.0, True, second(100))],
    ]
    stream = feed(spark, tmp_path / "in", rows, schema).withWatermark("at", "0 seconds")
    out = str(tmp_path / "out")
    drain(lv.progress(stream, "at").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    got = spark.read.parquet(out).where("item_id = 'i'").orderBy("elapsed_s", "stalled").collect()
    assert [(r.stage, round(r.fraction, 4), r.stalled) for r in got] == [("digest", 0.02, False), ("publisher", 0.23, False), ("publisher", 0.23, True), ("detector", 0.42, False)]
    first = 10.0 * 0.77 / 0.23
    assert got[0].eta_s is None and abs(got[1].eta_s - first) < 1e-9
    assert abs(got[3].eta_s - (0.7 * first + 0.3 * 100.0 * 0.58 / 0.42)) < 1e-9  # it knows what it knew before the stall


def test_history(spark, tmp_path):
    schema = "path string, produced_utc string, marks int"
    frames = [[("a", "1", 1), ("b", "1", 1)], [("./a", "2", 5)], [("c", "3", 1)], [("c/../b", "4", 2), ("d", "4", 7)]]
    folder = str(tmp_path / "h")
    drain(lv.keep_history(feed(spark, tmp_path / "in", frames, schema), folder, str(tmp_path / "c"), buckets=16))
    newest = lambda before=None: [(r.path, r.marks) for r in lv.version(spark, folder, before).orderBy(F.desc("produced_utc"), "path").collect()]
    assert newest() == [("c/../b", 2), ("d", 7), ("c", 1), ("./a", 5)]
    assert newest(3) == [("c", 1), ("./a", 5), ("b", 1)]
    manifests = sorted(p.name for p in (tmp_path / "h" / "manifests").glob("v=*"))
    assert manifests == ["v=2", "v=3"]
    # A batch rewrites only the buckets of its paths.
    assert len(list((tmp_path / "h" / "data" / "v=2").glob("__b=*"))) == 1
    assert not (tmp_path / "h" / "data" / "v=0").exists() or 0 in set(lv._manifest(spark, folder, 3).values())


def talk(seed, n=120):
    """Words of two sources of two recordings; some last long, some start together."""
    rng = random.Random(seed)
    rows = []
    for item in (1, 2):
        t = 0.0
        for i in range(n):
            t = round(t + rng.choice([0.4, 0.4, 0.4, 2.5]), 3)
            if rng.random() < 0.7:
                rows.append((item, "publisher", i, f"w{i % 9}", t, round(t + rng.choice([0.4, 0.4, 1.9]), 3)))
            rows.append((item, "detector", i, rng.choice([f"w{i % 9}", f" W{i % 9}. ", ""]), round(t + 0.1, 3), round(t + rng.choice([0.3, 0.5, 3.0]), 3)))
            if rng.random() < 0.1:
                rows.append((item, "detector", 1000 + i, "twin", round(t + 0.1, 3), round(t + 0.2, 3)))
    return sorted(rows, key=lambda r: r[4])


WORDS = "item_id long, source string, seq long, text string, start double, end double"
FEED = f"kind string, {WORDS}, audio_s double"


def marked(df):
    return sorted((r.item_id, r.start, r.end, r.span_start, r.span_end, r.detector_words, r.detector_text) for r in df.collect())


def batch_marks(spark, rows, audio):
    words = spark.createDataFrame(rows, WORDS)
    items = spark.createDataFrame([(1, audio), (2, audio)], "item_id long, audio_s double")
    return marked(rv.build_review(words.where("source = 'publisher'"), words.where("source = 'detector'"), items))


@pytest.mark.parametrize("seed, cuts", [(8, 3), (9, 20)])
def test_marks_as_words_arrive(spark, tmp_path, seed, cuts):
    rows = talk(seed)
    audio = max(r[5] for r in rows) + 5.0
    step = -(-len(rows) // cuts)
    frames = [[("word", *r, None) for r in rows[i : i + step]] for i in range(0, len(rows), step)]
    frames.append([("close", 1, None, None, None, None, None, audio), ("close", 2, None, None, None, None, None, audio)])
    frames.append([("word", 1, "publisher", 999, "late", 0.0, 0.1, None)])
    open_frames, out = len(frames) - 2, str(tmp_path / "m")
    source = feed(spark, tmp_path / "in", frames[:open_frames], FEED)
    drain(mk.incremental_marks(source, out, str(tmp_path / "c")))
    early = marked(mk.written(spark, out, "mark"))
    for i in range(2):  # the next run goes on from the state of the one before
        feed(spark, tmp_path / "in" / f"more{i}", [frames[open_frames + i]], FEED)
        drain(mk.incremental_marks(source, out, str(tmp_path / "c")))
    want = batch_marks(spark, rows, audio)
    assert marked(mk.written(spark, out, "mark")) == want and len(want) > 5
    assert 0 < len(early) < len(want) and set(early) < set(want)
    assert [r.text for r in mk.written(spark, out, "late").collect()] == ["late"]


def test_blocks_of_words(monkeypatch):
    """A batch reads the blocks that it needs, not all that came before."""

    class State:
        def __init__(self):
            self.rows, self.read = {}, 0

        def containsKey(self, key):
            return key in self.rows

        def getValue(self, key):
            self.read += 1
            return self.rows[key]

        def updateValue(self, key, value):
            self.rows[key] = value

    monkeypatch.setattr(mk, "BLOCK", 4)
    state, heard, most = State(), None, 0
    for batch in range(50):
        words = mk._Words(state, "detector", heard)
        for i in range(6):
            t = batch * 6.0 + i
            words.append((t, t + 0.5, i, "w", f"n{batch * 6 + i}"))
        state.read = 0
        assert words.before(batch * 6.0 + 3, 2) == [f"n{batch * 6 + 1}", f"n{batch * 6 + 2}"] or batch == 0
        most = max(most, state.read)
        words.save()
        heard = (words.n, words.seen, words.longest)
    assert most <= 8 and len(state.rows) == 75


def test_arriving_parts(spark, tmp_path):
    schema = "folder string, ext string, name string, start_utc timestamp, duration_s double"
    t = dt.datetime(2024, 1, 1, 10)
    minute = dt.timedelta(minutes=1)
    rows = [[("f", ".avi", "a", t, 600.0), ("f", ".avi", "b", t + 10 * minute, 600.0), ("f", ".avi", "c", t + 90 * minute, 60.0)], [("f", ".avi", "z", t + 6000 * minute, 1.0)]]
    stream = feed(spark, tmp_path / "in", rows, schema)
    drain(lv.arriving_parts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    assert sorted(r.parts for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_words_of_a_batch_are_taken_as_lists(monkeypatch):
    """A row of a frame costs several times the work on it, so the processor goes through none."""
    import pandas as pd
    from spanloom.config import ReviewSettings

    class State(dict):
        value = None
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__
        iterator = lambda self: iter(list(self.items()))
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            super().clear()
            self.value = None

    class Handle:
        getMapState = getValueState = lambda self, *a: State()

    monkeypatch.delattr(pd.DataFrame, "itertuples")
    columns = ["kind", "source", "seq", "text", "start", "end", "audio_s", "shown", "norm"]
    said = [("word", "publisher", n, f"p{n}", 2.0 * n, 2.0 * n + 0.5, None, f"p{n}", f"p{n}") for n in range(600)]
    heard = [("word", "detector", 2 * n + k, "d", 2.0 * n + 0.6 + k * 0.5, 2.0 * n + 0.9 + k * 0.5, None, "d", f"d{n}{k}") for n in range(600) for k in (0, 1)]
    other = [("word", "elsewhere", 0, "x", 0.0, 1.0, None, "x", "x")]
    one = mk.MarkProcessor(ReviewSettings())
    one.init(Handle())
    rows = [*said, *heard, *other]
    random.Random(3).shuffle(rows)
    out = []
    for batch in (rows, [("word", "publisher", 7, "late", 5.0, 5.5, None, "late", "late"), ("close", None, None, None, None, None, 1201.0, None, None)]):
        for frame in one.handleInputRows((1,), iter([pd.DataFrame(batch, columns=columns)]), None):
            out += [dict(zip(frame.columns, values)) for values in frame.to_numpy().tolist()]
    marks = [r for r in out if r["kind"] == "mark"]
    assert sorted(r["span_start"] for r in marks) == [2.0 * n + 0.5 for n in range(600)] and {r["detector_words"] for r in marks} == {2}
    assert [(r["source"], r["seq"], r["text"]) for r in out if r["kind"] == "late"] == [("publisher", 7, "late")]
