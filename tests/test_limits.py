"""What has no limit, and what must not be lost."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import catalog, timeline
from spanloom.operators import series as se
from spanloom.session import configure
from spanloom.sources import annotations, tokens


def search(grid):
    """The best mapping by trying all of them."""
    n, m = len(grid), len(grid[0]) if grid else 0
    best = None
    for choice in itertools.product(range(m + 1), repeat=n):
        used = [c for c in choice if c]
        if len(set(used)) == len(used):
            total = sum(round(grid[i][c - 1] * 1e9) for i, c in enumerate(choice) if c)
            key = (-total, len(used), list(choice))
            best = key if best is None or key < best else best
    return best[2] if best else []


def test_assignment_is_the_best_of_all():
    rnd = random.Random(1)
    for _ in range(150):
        n, m = rnd.randrange(0, 5), rnd.randrange(0, 5)
        grid = [[rnd.choice([0, 0, 1, 1, 2, rnd.random()]) for _ in range(m)] for _ in range(n)]
        assert timeline.assigned(grid) == search(grid)


def test_many_equal_labels_map_to_themselves(spark):
    rows = [("i", float(k), k + 1.0, f"speaker {k:02d}") for k in range(12)]
    df = spark.createDataFrame(rows, "item_id string, start double, end double, label string")
    out = timeline.diarization_errors(df, df, (0.0,)).first()
    assert (out.der, out.jer, out.n_ref_speakers, out.unmatched_ref) == (0.0, 0.0, 12, [])
    assert all(k == v for k, v in out.mapping.items()) and len(out.mapping) == 12


def test_segments_of_one_span_share_its_text_once(spark):
    segments = spark.createDataFrame([("i", "a", 0.0, 2.0), ("i", "a", 0.0, 2.0)], "item_id string, speaker string, start double, end double")
    words = spark.createDataFrame([("i", "a", 0.1, 0.2, "hi"), ("i", "a", 1.0, 1.2, "yo")], "item_id string, speaker string, start double, end double, text string")
    assert [r.text for r in annotations.fill_segments(segments, words).collect()] == ["hi yo", "hi yo"]


def test_history_keeps_every_path(spark):
    rows = spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("2020").alias("produced_utc"))
    assert catalog.upsert_history(rows.limit(0), rows).count() == 3000
    assert catalog.newest_entries(rows, 7).count() == 7


def test_equal_times_have_one_outcome(spark):
    rows = spark.createDataFrame([("a", "2020", 1), ("a", "2020", 3), ("a", "2020", 2)], "path string, produced_utc string, marks int")
    assert [r.marks for r in catalog.upsert_history(rows.limit(0), rows.repartition(3)).collect()] == [3]


def test_first_spelling_of_a_path_stays(spark):
    rows = spark.createDataFrame([("/X", "b.WAV", 2), ("/X", "B.wav", 1), ("/x", "b.wav", 3)], "folder string, name string, n int")
    assert [r.n for r in catalog.discover_media(rows.repartition(3)).collect()] == [1]


def test_settled_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Session())


def test_exploded_rows_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    """A small file may hold long lists: only what was shuffled tells how many rows come of it."""
    configure(spark)
    spark.range(50).selectExpr("id AS item_id", "sequence(1, 2000) AS tokens").write.parquet(f"{tmp_path}/t")
    words = spark.read.parquet(f"{tmp_path}/t").select("item_id", F.explode("tokens").alias("seq"))
    joined = words.join(words.withColumn("x", F.col("seq") + 1), ["item_id", "seq"])
    assert "BroadcastExchange" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_levels_at_a_low_rate_compare_near_samples_only(spark):
    """Ten samples a second: windows of one recording meet the samples of their own seconds."""
    samples = spark.range(20_000).select(F.lit(1).alias("item_id"), F.col("id").alias("idx"), F.when(F.col("id") < 10_000, 0.1).otherwise(0.001).alias("value"))
    windows = spark.range(190).select(F.lit(1).alias("item_id"), (F.col("id") * 10.0 + 3.0).alias("start"), (F.col("id") * 10.0 + 13.0).alias("end"))
    levels = {r.start: r.level for r in se.level_dbfs(samples, windows, 10).collect()}
    assert len(levels) == 190 and round(levels[3.0], 6) == -20.0 and round(levels[1893.0], 6) == -60.0


def test_tokens_that_repeat_a_place_start_at_the_earliest(spark):
    rows = [(1, 0, 0, " so", t, 0.1) for t in (9.0, 2.0, 5.0)]
    found = tokens.group_words(
        spark.createDataFrame(rows, "item_id long, seg long, pos long, token string, time double, duration double").repartition(3, "time"),
        spark.createDataFrame([(1, 0, 20.0, 0.0)], "item_id long, seg long, end double, offset double"),
    )
    assert [(r.seq, r.start) for r in found.collect()] == [(0, 2.0)]
