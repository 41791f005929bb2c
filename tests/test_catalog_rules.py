"""Claims on names in bounded number, items of a store, records of batches."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import wording as wd
from spanloom.operators import catalog as ct
from spanloom.sources import files as fl


def test_claims_against_all_pairs(spark):
    rng = random.Random(3)

    def path():
        steps = "/".join(rng.choice(["a", "b", "A", ".", "..", "c"]) for _ in range(rng.randrange(4)))
        return rng.choice(["/", "", "./", "x/"]) + steps

    claims = [(rng.choice("pqrs"), rng.choice([path(), path(), None])) for _ in range(60)]
    paths = sorted({path() + f"/{i % 5}" for i in range(80)})
    files = [(p, rng.choice(["", "p", "q"]), rng.choice("pqrst")) for p in paths]
    # Names with one recording, in one or two spellings, that some file is.
    for i, own in enumerate(paths[::8]):
        claims += [(f"n{i}", own)] + [(f"n{i}", own.replace("/", "/./", 1))] * (i % 2)
        files[8 * i] = (own, "n1", f"n{i}")
    claimed = spark.createDataFrame(claims, "base string, recorded string")
    rows = spark.createDataFrame(files, "path string, parent string, base string")
    pairs = rows.select("path").distinct().crossJoin(claimed.where("recorded IS NOT NULL"))
    differs = {}
    for r in pairs.select("path", "base", wd.same_recording("recorded", "path").alias("same")).collect():
        differs[r.path, r.base] = differs.get((r.path, r.base), False) or not r.same
    met = rows.select("path").distinct().crossJoin(ct.claim_witnesses(claimed.withColumnRenamed("base", "name")))
    found = {}
    for r in met.select("path", "name", wd.same_recording("recorded", "path").alias("same")).collect():
        found[r.path, r.name] = found.get((r.path, r.name), False) or not r.same
    assert found == differs and set(found.values()) == {True, False}
    for r in ct.output_paths(rows, claimed).collect():
        options = [r.base] + ([f"{r.parent}-{r.base}"] if r.parent else [])
        free = [o for o in options if not differs.get((r.path, o), False)]
        assert r.output == free[0] if free else r.output.startswith(f"{r.base}-") and len(r.output) == len(r.base) + 9


def test_a_name_that_many_recordings_claim(spark):
    """20,000 files against 20,000 claims of one name: few witnesses, no pairs."""
    files = spark.range(20_000).select(F.format_string("/r/%d/a.wav", "id").alias("path"), F.lit("").alias("parent"), F.lit("a").alias("base"))
    claims = files.select("base", F.col("path").alias("recorded"))
    assert ct.claim_witnesses(claims.withColumnRenamed("base", "name")).count() <= 36
    assert ct.output_paths(files, claims).where("output LIKE 'a-________'").count() == 20_000
    one = claims.where("recorded = '/r/7/a.wav'")
    assert [r.path for r in ct.output_paths(files, one).where("output = 'a'").collect()] == ["/r/7/a.wav"]
    assert ct.output_paths(files, claims.limit(0)).where("output = 'a'").count() == 20_000


def test_items_of_a_store(spark):
    present = spark.createDataFrame(
        [("h", "calls/1/transcript.json"), ("h", "calls/2/agent.wav"), ("h", "calls/3/transcript.json"), ("h", "calls/3/transcript.json"),
         ("m", "x.wav"), ("l", "utterances/b.flac"), ("l", "utterances/a.b.flac"), ("l", "utterances/a.trans.txt"), ("l", "utterances/in/c.flac"), ("h", "utterances/no.flac")],
        "key string, file string",
    )
    calls = spark.createDataFrame([("h", "hvb", c, i) for i, c in enumerate("3214")] + [("gone", "g", "1", 9)], "key string, prefix string, call string, place int")
    meetings = spark.createDataFrame(
        [(k, "ami", "M1", mic, f"{mic}.wav", i, 780.0, 960.0) for k in ("m", "gone") for i, mic in enumerate(("headset", "array"))],
        "key string, prefix string, meeting string, microphone string, source string, place int, window_start double, window_end double",
    )
    utterances = spark.createDataFrame([("l", "lib", "utterances"), ("gone", "g", "utterances")], "key string, prefix string, folder string")
    found = ct.list_items(present, calls, meetings, utterances).orderBy("section", "place", "item_id").collect()
    assert [r.item_id for r in found] == [
        "hvb/3", "hvb/1", "ami/M1/headset/780-960", "ami/M1/array/780-960", "ami/M1/headset/full", "ami/M1/array/full", "lib/a.b", "lib/b",
    ]
    assert [(r.source, r.kind, r.window_start, r.window_end) for r in found[2:5:2]] == [("headset.wav", "ami-meeting", 780.0, 960.0), ("headset.wav", "ami-meeting", None, None)]
    assert found[-1].source == "b.flac" and ct.list_items(present.limit(0), calls, meetings, utterances).count() == 0


def test_batch_records(spark, tmp_path):
    path = str(tmp_path / "batches")
    rows = spark.createDataFrame([("/a", "ok", None, None), ("/b", "failed", "ValueError", "no sound"), ("/c", "cancelled", None, None)], "path string, status string, error_class string, error string")
    fl.write_batch(rows, path, "2026/1", {"profile": "standard", "started_utc": "t0", "plan": {"free_gb": "9"}, "threshold": 0.5})
    fl.write_batch(rows.limit(0), path, "none", {})
    fl.write_batch(rows, path, "foreign", {"schema": "other"})
    fl.write_batch(rows, path, "none", {"speakers": 2})
    fl.write_batch(rows.limit(0), path, "none", {"speakers": 3})
    batches, stored = fl.read_batches(spark, path)
    found = {r.batch: r for r in batches.collect()}
    assert set(found) == {"2026/1", "none"}
    first = found["2026/1"]
    assert (first.n_ok, first.n_failed, first.n_cancelled, first.plan, first.threshold, first.speakers) == (1, 1, 1, {"free_gb": "9"}, 0.5, None)
    assert (found["none"].n_ok, found["none"].speakers) == (0, 3)
    assert [tuple(r) for r in ct.failed(stored).collect()] == [("2026/1", "/b", "failed", "ValueError", "no sound")]
    assert stored.count() == 3
    assert all(frame.count() == 0 for frame in fl.read_batches(spark, path, "third"))
