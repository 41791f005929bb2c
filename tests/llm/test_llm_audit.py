import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spanloom.llm import audit


def test_merges():
    rnd = random.Random(7)
    for _ in range(400):
        sets = [set(rnd.sample(range(60), rnd.randrange(rnd.choice([3, 60])))) for _ in range(rnd.randrange(1, 6))]
        lists = [sorted(s) for s in sets]
        assert audit.union(lists) == sorted(set().union(*sets))
        assert audit.difference(lists[0], lists[-1]) == sorted(sets[0] - sets[-1])
        for value in range(0, 61, 7):
            at = rnd.randrange(len(lists[0]) + 1)
            assert audit.gallop(lists[0], value, at) == max(at, sum(x < value for x in lists[0])) if at < len(lists[0]) else True


def plain(rows, good, toxic):
    """Every order applied to every document, one after the other."""
    fails = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [j for j, t, _ in rows if (t or "") == text and j is not None]
        copy = any(j < i for j in ids) if i is not None else bool(ids)
        fails.append((lang or "", {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                failing = sum(d[1][f] for d in mine)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def run(df, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.filter_audit(df, labels).collect()}


@pytest.mark.parametrize("width", [3, 1 << 13])
def test_against_every_order(spark, monkeypatch, width):
    monkeypatch.setattr(audit, "RANGE", width)
    rnd = random.Random(width)
    texts = [None, "", "a b", "Word " * 200, " ".join(map(str, range(300))), "é#" * 40, "x y z " * 90, "A" + "é" * 33, "A" + "é" * 32]
    rows = [(i // 2, rnd.choice(texts), rnd.choice(["en", None, "", "de"])) for i in range(60)]
    rows += [(None, "a b", "en"), (None, "a b", "de"), (None, "none other", None), (3, "a b", "fr"), (3, "a b", "fr")]
    marks = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 30, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"_row": F.lit(1), "part": F.lit("p"), "_digest": F.col("text"), "name": F.lit(0), "range": F.lit(0)})
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").withColumn("_row", F.lit(5))
    want = plain(rows, {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None})
    assert run(df, labels) == want and len(want) == 4 * 600


def test_nothing_fails_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)), "en")], "doc_id bigint, text string, lang string")
    got = run(clean, labels)
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}
    assert run(clean.filter("false"), labels) == {}


def test_very_long_text(spark):
    rows = [(1, "w " * 2_000_000, "en"), (2, "w " * 2_000_000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = run(df, spark.createDataFrame([(2, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert got == plain(rows, {2}, {2})
