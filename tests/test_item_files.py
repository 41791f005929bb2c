"""Digests of files and chains as streams; a file per item, published whole or not at all."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import catalog as ct
from spanloom.sources import digests as dg
from spanloom.sources import files as fl
from spanloom.sources import item_files as it
from test_documents import document


def test_digests_of_small_and_streamed_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a b%20c").mkdir(parents=True)
    contents = {"empty.bin": b"", "a b%20c/x y.bin": os.urandom(3000), "a b%20c/ä.bin": os.urandom(5 << 20), "z.gz": os.urandom(70_000)}
    for name, content in contents.items():
        (root / name).write_bytes(content)
    wanted = {(n.rsplit("/", 1)[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}
    for limit in (-1, 3000, 1 << 30):
        found = dg.file_digests(spark, str(root), limit)
        assert {(r.path.rsplit("/", 1)[-1], r.bytes, r.sha256) for r in found.collect()} == wanted
    assert {(r.name, r.bytes, r.sha256) for r in fl.inventory(spark, str(root), digests=True).collect()} == wanted
    assert {(r.name, r.bytes) for r in fl.inventory(spark, str(root)).collect()} == {w[:2] for w in wanted}


def test_digest_of_a_file_beyond_one_value(spark, tmp_path):
    """A sparse file of 3 GB, which no row could hold."""
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "big.bin", "wb") as file:
        file.truncate(3 << 30)
    plain, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(3 << 6):
        plain.update(block)
    row = fl.inventory(spark, str(tmp_path / "in"), digests=True).first()
    assert (row.bytes, row.sha256) == (3 << 30, plain.hexdigest())


def test_chain_digests_against_a_plain_fold(spark):
    rng = random.Random(5)
    rows = []
    for folder, chain, n in (("f", "a", 30_000), ("f", None, 3), (None, "a", 1), ('q"{', "a", 7), ("g", "none", 2)):
        for part in range(n):
            sha = None if chain == "none" else hashlib.sha256(f"{folder}{chain}{part}".encode()).hexdigest()
            rows.append((folder, chain, part, sha, None if n == 2 else rng.randrange(1 << 40)))
    wanted = {}
    for folder, chain, _, sha, size in rows:
        digest, total = wanted.setdefault((folder, chain), [hashlib.sha256(), None])
        digest.update((sha or "").encode())
        wanted[folder, chain][1] = total if size is None else (total or 0) + size
    rng.shuffle(rows)
    parts = spark.createDataFrame(rows, "folder string, chain string, part bigint, sha256 string, bytes bigint")
    found = {(r.folder, r.chain): (r.sha256, r.bytes) for r in ct.parts_digest(parts).collect()}
    assert found == {k: (d.hexdigest(), b) for k, (d, b) in wanted.items()}
    assert ct.parts_digest(parts.limit(0)).count() == 0


def _texts(spark, path):
    texts = {}
    for r in it.read_items(spark, path).orderBy("item_id", "part").collect():
        texts[r.item_id] = texts.get(r.item_id, "") + r.value
    return texts


@pytest.mark.parametrize("merged", [True, False])
def test_a_file_per_item(spark, tmp_path, merged):
    """With small partitions left as they are, an item of many rows is several tasks' work."""
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    names = ["plain", "a/b", "..", "_hidden", "x+y %2F", "ü", "dot.ted"]
    rows = [(n, i, f"{n} {i}") for n in names for i in range(5)] + [("long", i, str(i)) for i in range(20_000)] + [("null", 0, None)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "item_id string, at int, value string").repartition(5)
    try:
        it.write_items(frame, path, ["at"], "srt")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    texts = _texts(spark, path)
    assert texts.pop("long") == "".join(f"{i}\n" for i in range(20_000))
    assert texts.pop("null") == "\n"
    assert texts == {n: "".join(f"{n} {i}\n" for i in range(5)) for n in names}
    assert merged or it.read_items(spark, path).where("item_id = 'long'").count() > 1


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    assert it.read_items(spark, path).count() == 0
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.lit(0).alias("at"), F.lit("first").alias("value"))
    it.write_items(items, path, ["at"])
    failing = items.withColumn("value", F.when(F.col("item_id") == 2990, F.raise_error(F.lit("lost"))).otherwise(F.lit("second")))
    for bad in (failing.repartition(4), items.union(items.limit(1).withColumn("item_id", F.lit(None).cast("bigint")))):
        with pytest.raises(Exception):
            it.write_items(bad, path, ["at"])
        assert it.versions(path) == ["v00000001"] and not os.listdir(f"{path}/_staging")
        assert set(_texts(spark, path).values()) == {"first\n"} and len(_texts(spark, path)) == 3000
    # Folders stay bounded however many items there are; Spark's own reader sees whole versions only.
    folders = [files for _, _, files in os.walk(f"{path}/v00000001") if files]
    assert sum(map(len, folders)) == 3000 and max(map(len, folders)) <= it.FOLDER_FILES


def test_a_lost_attempt_leaves_nothing_visible(spark, tmp_path):
    """Files of an attempt whose message never came are not part of the version."""
    path = str(tmp_path / "out")
    writer = it.ItemFilesWriter(path, "txt")
    stray = tmp_path / "out" / "_staging" / writer.run / "00000000-lost" / "000000"
    stray.mkdir(parents=True)
    (stray / "half.txt").write_text("half")
    kept = tmp_path / "out" / "_staging" / writer.run / "00000000-done" / "000000"
    kept.mkdir(parents=True)
    (kept / "whole.txt").write_text("whole\n")
    writer.commit([it.Written(0, str(kept.parent), 1), None])
    assert _texts(spark, path) == {"whole": "whole\n"} and not os.listdir(f"{path}/_staging")


def test_versions_replace_one_another(spark, tmp_path):
    path = str(tmp_path / "out")
    for text in ("one", "two", "three"):
        it.write_items(spark.createDataFrame([(1, 0, text)], "item_id int, at int, value string"), path, ["at"])
        assert _texts(spark, path) == {"1": f"{text}\n"}
    assert it.versions(path) == ["v00000002", "v00000003"]
    it.write_items(spark.createDataFrame([], "item_id int, at int, value string"), path, ["at"])
    assert it.versions(path)[-1] == "v00000004" and it.read_items(spark, path).count() == 0


def test_exports_as_item_files(spark, tmp_path):
    docs = document(spark)
    report = fl.export_outputs(docs, str(tmp_path), "call", ["text", "srt", "transcript"], write=it.write_items)
    assert all(r.written for r in report.collect())
    assert _texts(spark, str(tmp_path / "call.text"))["1"].startswith("call.wav\nDuration 0:20   |   2 speakers")
    assert _texts(spark, str(tmp_path / "call.srt"))["1"].startswith("1\n")
