"""Scores name their normaliser and are never pooled or set side by side across two."""

from pyspark.sql import functions as F

from spanloom.functions.text import normaliser_version
from spanloom.operators import align as al
from spanloom.plans import report as rp

SPELLINGS = {"harbour": "harbor"}


def words(spark, texts, **more):
    rows = [(1, i, float(i), i + 0.5, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "item_id long, seq int, start double, end double, text string")
    return frame.withColumns({k: F.lit(v) for k, v in more.items()})


def both(spark):
    ref = words(spark, ["The", "harbour", "is", "wide"], speaker="a")
    hyp = words(spark, ["the", "harbor", "is", "wide"], variant="x")
    return [rp.transcript_scores(ref, hyp, spellings) for spellings in (None, SPELLINGS)]


def test_versions_stay_apart(spark):
    plain, spelled = both(spark)
    other = normaliser_version(SPELLINGS)
    for scores, version in ((plain, normaliser_version()), (spelled, other)):
        assert all([r[0] for r in frame.select("normaliser").distinct().collect()] == [version] for frame in scores.values())
    errors, recall = plain["errors"].unionByName(spelled["errors"]), plain["recall"].unionByName(spelled["recall"])
    pooled = al.pooled_word_errors(errors.where("tokens = 'norm'"), ["variant"]).collect()
    assert {(r.normaliser, r["items"], r.wer) for r in pooled} == {("v1", 1, 0.25), (other, 1, 0.0)}
    totals = al.pooled_with_subtotals(errors.where("tokens = 'norm'").withColumn("group", F.lit("g"))).collect()
    assert {(r.normaliser, r.level, r.wer) for r in totals} == {(v, level, w) for v, w in (("v1", 0.25), (other, 0.0)) for level in (0, 1, 3)}
    assert {r.value.split(" | ")[1] for r in rp.accuracy_table(errors).collect()} == {"x", f"x ({other})"}
    items = spark.createDataFrame([(1, 4.0)], "item_id long, audio_s double")
    rows = {r.normaliser: r.value for r in rp.item_table(errors, recall, items).collect()}
    assert len(rows) == 2 and "25.0 (1/0/0)" in rows["v1"] and "0.0 (0/0/0)" in rows[other]


def test_scores_without_a_version_pool_as_before(spark):
    errors = both(spark)[0]["errors"].drop("normaliser")
    twice = errors.unionByName(errors).withColumn("group", F.lit("g")).where("tokens = 'norm'")
    assert [r["items"] for r in al.pooled_word_errors(twice, ["variant"]).collect()] == [2]
    assert sorted(r.level for r in al.pooled_with_subtotals(twice).collect()) == [0, 1, 3]
    assert rp.accuracy_table(errors).count() == 1
