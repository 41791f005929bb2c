import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import fingerprints as fp
from spanloom.llm.neighbours import with_next
from spanloom.llm.queries import R


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collisions_estimate_generalised_jaccard(spark):
    rnd = random.Random(17)
    texts = []
    for pair in range(120):
        words = [f"w{pair}-{i}" for i in range(60)]  # of their own, so that errors are independent
        a = rnd.choices(words, k=rnd.randrange(20, 200))
        texts += [" ".join(a), " ".join([*a[: rnd.randrange(len(a))], *rnd.choices(words, k=rnd.randrange(0, 90))]) + " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    signed = fp.signatures(df, "text", ["id"], samples=48)
    rows = {r.id: r._signature for r in signed.collect()}
    errors = []
    for i in range(0, len(texts), 2):
        got = sum(x == y for x, y in zip(rows[i], rows[i + 1])) / 48
        errors.append(got - jaccard(texts[i], texts[i + 1]))
    assert abs(sum(errors) / len(errors)) < 0.03  # no bias
    assert sum(e * e for e in errors) / len(errors) < 0.25 / 48 * 1.6  # the variance of a share of 48


def test_weights_count(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, "a b a a"), (3, "A\tb  a a "), (4, None), (5, " "), (6, "b")], "id bigint, text string")
    rows = {r.id: r._signature for r in fp.signatures(df, "text", ["id"]).collect()}
    assert rows[1] == rows[2] == rows[3] and rows[4] == rows[5] == [0] * fp.SAMPLES and rows[6] != rows[1]


def test_next_rows(spark):
    rnd = random.Random(18)
    for ids in ([5], [1, 2], [*rnd.sample(range(-(10**12), 10**12), 300)], [*range(1000, 1200), 10**15, -(10**15)], [7, 7, 7, 3]):
        rows = [(i, f"t{n}") for n, i in enumerate(ids)]
        rnd.shuffle(rows)
        got = with_next(spark.createDataFrame(rows, "k bigint, v string"), "k", ["k", "v"], ["v"]).collect()
        order = sorted(rows, key=lambda r: (-r[0], r[1]))
        assert sorted((r.k, r.v, r._next_k, r._next_v) for r in got) == sorted((*a, *b) for a, b in zip(order, order[1:] + order[:1]))
    nulls = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "k bigint, v string")
    assert {r.v: r._next_v for r in with_next(nulls, "k", ["v"], ["v"]).collect()} == {"b": "a", "a": "n", "n": "b"}
    assert with_next(nulls.filter("false"), "k", ["v"], ["v"]).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect(), reverse=True)
    got = {r.doc_id: r for r in R.queries["op2_fingerprints"](spark, folder).collect()}
    assert len(got) == len(docs)
    near = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        near.append(got[i].near_edited - jaccard(text, edited))
        assert (got[i].fingerprint == got[i].edited_fingerprint) <= (got[i].near_edited == 1.0)
    assert abs(sum(near) / len(near)) < 0.05
    by_text = {}
    for i, text in docs:
        by_text.setdefault(text, set()).add(got[i].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_one_join_at_any_size(spark):
    found = R.queries["op2_fingerprints"](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
