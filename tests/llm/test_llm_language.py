import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import language
from spanloom.llm.common import table

SMALL = "/root/testdata/sf0.001"


def greedy(sample: bytes, text: bytes) -> int:
    """Phrases of a text, window by window, by search in the sample."""
    count = 0
    for begin in range(0, len(text), language.WINDOW):
        part, at = text[begin : begin + language.WINDOW], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at : end + 1] in sample and part[at:end] in sample:
                end += 1
            at, count = end, count + 1
    return count


def test_phrases_are_longest_matches():
    rnd = random.Random(2)
    sample = bytes(rnd.choice(b"abc") for _ in range(400))
    made = language.SuffixAutomaton(sample)
    texts = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(0, 2500))) for _ in range(20)]
    windows, lengths, owner = language._windows(texts)
    got = np.bincount(owner, weights=language.phrases(made.symbols, made.step, windows, lengths), minlength=len(texts))
    assert got.tolist() == [greedy(sample, t) for t in texts]


def test_held_out_accuracy(spark):
    docs = table(spark, SMALL, "documents")
    found = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in found)


def test_label_source_and_id_are_no_inputs(spark):
    docs = table(spark, SMALL, "documents").limit(60)
    samples = language.learn(table(spark, SMALL, "documents"))
    one = language.identify(docs.select("text", F.col("text").alias("_row")), samples)
    two = language.identify(docs.select("text", F.reverse("text").alias("_row")), samples).withColumn("_row", F.reverse("_row"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_edges(spark, docs):
    samples = {"aa": b"the quick brown fox", "bb": b"der schnelle fuchs"}
    rows = [(1, None), (2, ""), (3, "12 34\n"), (4, "the fox"), (5, "der fuchs"), (5, "der fuchs"), (None, "x" * 5000)]
    df = docs(rows)
    found = {r._row: r for r in language.identify(df.select("text", F.col("doc_id").alias("_row")), samples).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "aa", "bb"]
    assert found[1].score == 0 and found[1].phrases_per_byte is None
    empty = docs([]).withColumn("lang", F.lit("aa"))
    assert language.language_id(empty).collect() == []
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(unlabelled).collect()} == {"und"}
