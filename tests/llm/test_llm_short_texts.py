import corpus_pipeline as cp


def test_short_texts_with_a_letter_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = ["q", "Ж", "xq", "zqj", "да", " ok ", "a1"]
    gone = ["Ж" * 40, "жщ " * 40, "7 8", "", None]
    # Without a label nothing is learned from them.
    rows = [(200_000 + i, t, None, "src1", len(t or "")) for i, t in enumerate(short + gone)]
    kept = dict(cp.STAGES)["language_id"](spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "")
    assert {r.doc_id - 200_000 for r in kept.collect() if r.doc_id >= 200_000} == set(range(len(short)))
