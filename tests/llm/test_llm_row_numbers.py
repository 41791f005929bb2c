"""Files that are split otherwise from one job to the next, as on a cluster whose executors come and go."""

import corpus_pipeline as cp
import pytest

from spanloom.llm.common import ready
from spanloom.llm.repeats import remove_repeats
from spanloom.session import scratch

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def in_files(spark):
    """Writes rows as several files; `split` says how they are read from then on."""
    before = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")

    def make(rows, columns):
        path = scratch(spark, "files")
        ready(spark).createDataFrame(rows, columns).repartition(6, "doc_id").write.parquet(path)
        return spark.read.parquet(path)

    def split(alone):
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set(SPLIT, "1k" if alone else before[0])

    yield make, split
    spark.conf.set(SPLIT, before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def text(i):
    return " ".join(f"w{(i * 7919 + k * k * 31) % 9973}" for k in range(40))


def test_repeats(in_files):
    make, split = in_files
    df = make([(i, text(i % 20)) for i in range(40)], "doc_id bigint, text string")
    split(True)
    found = remove_repeats(df)
    split(False)
    got = {r.doc_id: (r.n_removed, r.n_bytes) for r in found.collect()}
    assert len(got) == 40 and all(gone == (0 if i < 20 else n) for i, (gone, n) in got.items())


@pytest.mark.parametrize("stage", ["near_duplicates", "mixing"])
def test_stages(in_files, spark, stage):
    make, split = in_files
    rows = [(i, text(i), "en", "src1", 1) for i in range(40)]
    df = make(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    split(True)
    found = dict(cp.STAGES)[stage](spark, df, "")
    split(False)
    assert sorted(r.doc_id for r in found.collect()) == list(range(40))
