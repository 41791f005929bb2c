"""Long pairs, long texts and large groups: the same results as in one piece."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import align as al
from spanloom.operators import long_align as la

STEP = ["op_seq", "kind", "ref_at", "hyp_at", "ref_token", "hyp_token", "chunk"]


def spoiled(rng, tokens, rate):
    out = []
    for t in tokens:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice("abcdef") if x < 2 * rate / 3 else t)
        if x > 1 - rate / 3:
            out.append(rng.choice("abcdef"))
    return out


def ops(df):
    return {(r.item_id, r.op_seq): tuple(r[c] for c in STEP) for r in df.select("item_id", *STEP).collect()}


def test_blocks_give_the_steps_of_one_table(spark):
    rng = random.Random(4)
    rows = []
    for item in range(12):
        ref = [rng.choice("abcd") for _ in range(rng.randrange(1, 120))]
        hyp = spoiled(rng, ref, rng.choice([0.1, 0.6])) or ["a"]
        rows.append((item, "v", ref, hyp))
    rows += [(50, "v", list("abc"), list("zzabc")), (51, "v", list("abcabc"), list("abc")), (52, "v", list("xyz"), list("a")), (53, "v", list("a"), list("qrsa") * 9), (54, "v", list("ab") * 40, list("ba") * 33)]
    pairs = spark.createDataFrame(rows, "item_id long, variant string, ref array<string>, hyp array<string>")
    whole = ops(al.edit_ops(pairs))
    for cells in (1, 300):  # a row of the table a block, and a few
        assert ops(la.long_edit_ops(pairs, ["item_id", "variant"], 5, cells)) == {k: v for k, v in whole.items()}
    assert ops(al.edit_ops(pairs, long_tokens=60)) == whole


def test_a_long_pair_over_several_tasks(spark):
    rng = random.Random(5)
    ref = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    hyp = spoiled(rng, ref, 0.004)
    pairs = spark.createDataFrame([(1, "v", ref, hyp)], "item_id long, variant string, ref array<string>, hyp array<string>")
    got = la.long_edit_ops(pairs, ["item_id", "variant"], 5, cells=1 << 21)
    kinds, i, j = al.trace(ref, hyp)
    rows = got.orderBy("op_seq").collect()
    assert [r.ref_at for r in rows] == [x if x >= 0 else None for x in i.tolist()]
    assert [r.hyp_at for r in rows] == [x if x >= 0 else None for x in j.tolist()]
    same = [r.ref_token is not None and r.ref_token == r.hyp_token for r in rows]
    assert [r.chunk for r in rows] == [x if x >= 0 else None for x in al._chunks(np.array(same), 5).tolist()]


def test_character_distance():
    rng = random.Random(6)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randrange(rng.choice([4, 90])))) for _ in range(2))
        assert al.character_distance(a, b) == table(a, b)
    long = "".join(rng.choice("abcde ") for _ in range(100_000))
    other = long[:40_000] + "x" + long[40_003:]
    assert al.character_distance(long, other) == 3


def test_both_kernels_of_text_distance(spark):
    rows = [("abc" * 40, "abd" * 41), ("", "abc"), ("", ""), ("x" * 5000, "x" * 4990 + "y" * 20)]
    df = spark.createDataFrame(rows, "a string, b string")
    want = [r.d for r in df.select(F.levenshtein("a", "b").alias("d")).collect()]
    for native in (10, 100_000):
        assert [r.d for r in df.select(al.text_distance("a", "b", native).alias("d")).collect()] == want


def test_quantiles_like_the_plain_function(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([0.0, 0.25, 0.25, rng.random(), rng.random() * 1000])) for k in (1, 1, 1, 2) for _ in range(300)] + [(3, 1.5), (4, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    shares = (0.0, 0.3, 0.5, 0.9, 1.0)
    plain = df.where("x IS NOT NULL").groupBy("k").agg(F.count("*"), *[F.percentile("x", F.lit(s)) for s in shares])
    assert sorted(map(tuple, al.exact_quantiles(df, "x", shares, ["k"]).collect())) == sorted(map(tuple, plain.collect()))


def test_pairs_of_a_long_meeting_are_traced_in_one_piece(spark, monkeypatch):
    """Rows of bits trace some 70,000 tokens in a second or two; blocks of the banded table take longer."""
    monkeypatch.setattr(la, "long_edit_ops", None)
    ref = [f"w{n % 977}" for n in range(21_000)]
    hyp = [t for n, t in enumerate(ref) if n % 500]
    pairs = spark.createDataFrame([(1, "v", ref, hyp)], "item_id long, variant string, ref array<string>, hyp array<string>")
    got = {r.kind: r.n for r in al.edit_ops(pairs).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"equal": len(hyp), "del": len(ref) - len(hyp)}
