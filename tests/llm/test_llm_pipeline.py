import corpus_pipeline as cp
from pyspark.sql import functions as F

from spanloom.llm import lines
from spanloom.llm.common import settled
from test_llm_lines import plain
from test_llm_shingles import plain_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_restatements(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(cp.STAGES)
    columns = docs.columns
    junk = spark.createDataFrame([(100_001, "123 ...", "en", "src1", 7), (100_002, None, None, None, None), (100_003, "", "en", None, 0)], docs.schema)
    known = settled(stage["language_id"](spark, docs.unionByName(junk), FOLDER), "a")
    assert known.columns == columns
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text))}

    cut = settled(stage["line_dedup"](spark, known, FOLDER), "b")
    assert cut.columns == columns
    digests = sorted((r.doc_id, r.d) for r in cut.select("doc_id", F.sha2("text", 256).alias("d")).collect())
    want = plain([(r.doc_id, r.text) for r in known.collect()], lines.MIN_CHARS, lines.MIN_DOCS)
    assert digests == sorted((i, d) for i, _, _, d in want)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = settled(stage["near_duplicates"](spark, cut, FOLDER), "c")
    rows = sorted((r.doc_id, r.text) for r in cut.collect())
    stays = {least for _, least in plain_groups(rows)}
    assert sorted(tuple(r) for r in single.select("doc_id", "text").collect()) == [r for r in rows if r[0] in stays]

    mixed = settled(stage["mixing"](spark, single, FOLDER), "d")
    assert mixed.columns == columns
    texts = {(r.doc_id, r.text) for r in single.collect()}
    assert all((r.doc_id, r.text) in texts for r in mixed.collect())

    done = stage["sentencepiece"](spark, mixed, FOLDER).collect()
    assert len(done) == mixed.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in done)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        docs = settled(stage(spark, docs, FOLDER), "none")
    assert docs.count() == 0


def test_stages_on_null_empty_and_repeated_rows(spark):
    """Each stage but the first on rows that the first would drop."""
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    line = "a line of more than forty characters that many share"
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "Some words here", "en", "src1", 15), (3, "Some words here", "en", "src1", 15), (None, "Other words there", "de", None, 17), (4, " \n\t", "fr", "src2", 3)]
    rows += [(10 + i, f"{line}\nown {i}", "en", f"src{i}", len(line) + 6) for i in range(6)]
    docs = settled(spark.createDataFrame(rows, schema), "odd")
    stage, found = dict(cp.STAGES), {}
    for name in ("line_dedup", "near_duplicates", "mixing"):
        found[name] = sorted((tuple(r) for r in stage[name](spark, docs, FOLDER).collect()), key=str)
    same = [r for r in rows if (r[0] or 0) < 10]
    cut = [(i, f"own {i - 10}", "en", f"src{i - 10}", 5) for i in range(10, 15)]
    want = [(i, t, a, b, len(t or "")) for i, t, a, b, _ in same] + cut + [rows[-1]]
    assert found["line_dedup"] == sorted(want, key=str)
    # Documents 1, 2 and 4 have no words; 10 to 15 share 7 of 9 shingles.
    kept = [r for i, r in enumerate(rows) if i not in (1, 3, 5)]
    assert found["near_duplicates"] == sorted(kept, key=str)
    assert set(found["mixing"]) <= set(rows) and all((r[1] or "").split() for r in found["mixing"])
    done = stage["sentencepiece"](spark, docs, FOLDER).collect()
    assert len(done) == len(rows) and all(r.round_trip for r in done if r.doc_id != 4)
    assert [r.n_ids for r in done if r.doc_id in (1, 2)] == [0, 0] and sum(r.doc_id == 3 for r in done) == 2


def test_near_duplicates_by_fingerprints_too(spark):
    """Word repeats that leave the fingerprint as it is, though fewer than 0.8 of all shingles are shared."""
    base = " ".join(f"word{i % 40}" for i in range(400))
    rows = [(1, base), (2, base + " one two three four five six seven eight nine ten eleven twelve"), (3, "quite another text of its own kind"), (4, base)]
    schema = "doc_id long, text string"
    docs = settled(spark.createDataFrame(rows, schema), "fingers")
    near = {r.doc_id: r.component_id for r in cp.simhash.simhash_groups(docs).collect()}
    similar = {r.doc_id: r.component_id for r in cp.shingles.shingle_groups(cp.numbered_rows(docs).select("_row", "_doc.doc_id", "_doc.text")).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 1} and similar == {1: 1, 2: 2, 3: 3, 4: 1}
    stay = dict(cp.STAGES)["near_duplicates"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3]


def test_shingles_meet_in_any_number_of_passes(spark, monkeypatch):
    rows = [(i, f"word one two three four five six seven eight nine ten eleven {'twelve' if i % 3 else ''} {i % 2}") for i in range(12)]
    docs = settled(spark.createDataFrame(rows, "doc_id long, text string"), "alike")
    found = []
    for passes in (1, 4):
        monkeypatch.setattr(cp.shingles, "PASSES", passes)
        groups = cp.shingles.shingle_groups(cp.numbered_rows(docs).select("_row", "_doc.doc_id", "_doc.text"))
        found.append({r.doc_id: r.component_id for r in groups.collect()})
    assert found[0] == found[1] == {i: least for i, least in plain_groups(rows)}
