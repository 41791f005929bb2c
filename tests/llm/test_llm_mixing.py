import hashlib
import random

from pyspark.sql import functions as F

from spanloom.llm import mixing


def pour(budget, children):
    """Shares of a budget among (name, cap, weight): what one cannot hold goes to the others."""
    given = {name: 0.0 for name, _, _ in children}
    open_ = {name: (cap, w) for name, cap, w in children if cap > 0 and w > 0}
    while open_ and budget > 1e-9:
        total = sum(w for _, w in open_.values())
        full = {n: cap for n, (cap, w) in open_.items() if cap <= budget * w / total}
        if not full:
            for n, (_, w) in open_.items():
                given[n] = budget * w / total
            break
        for n, cap in full.items():
            given[n], budget = cap, budget - cap
            del open_[n]
    return given


WEIGHTS = {"a": {"x": 3, "z": 0}, "b": {"p": 2}, "c": {}}


def test_allocation(spark):
    rnd = random.Random(20)
    leaves = [(a, b, c, rnd.randrange(0, 500)) for a in "xyz" for b in "pq" for c in "klm" if rnd.random() < 0.9]
    for budget in (0, 100, 1500, 4000, 10**9):
        df = spark.createDataFrame(leaves, "a string, b string, c string, available bigint")
        got = {(r.a, r.b, r.c): r.allocated for r in mixing.allocate(df, ["a", "b", "c"], WEIGHTS, budget, 2).collect()}
        cap = lambda rows: sum(2.0 * r[3] for r in rows if r[0] != "z")
        top = pour(min(budget, cap(leaves)), [(a, cap([r for r in leaves if r[0] == a]), {"x": 3, "z": 0}.get(a, 1)) for a in "xyz"])
        for a in "xyz":
            mid = pour(top[a], [(b, cap([r for r in leaves if r[:2] == (a, b)]), {"p": 2}.get(b, 1)) for b in "pq"])
            for b in "pq":
                low = pour(mid[b], [(r[2], cap([r]), 1) for r in leaves if r[:2] == (a, b)])
                for c, share in low.items():
                    assert abs(got[a, b, c] - share) <= 1.001, (budget, a, b, c)
        assert sum(got.values()) <= budget and sum(got.values()) >= min(budget, cap(leaves)) - len(leaves)


def test_prefix_of_the_seeded_epoch(spark):
    rnd = random.Random(21)
    rows = [(i, rnd.choice("pq"), rnd.choice(["k", "l", None]), rnd.randrange(0, 50)) for i in range(600)] + [(None, "p", "k", None), (3, "p", "k", -5), (3, "p", "k", 7), (3, "p", "k", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, b string, c string, n_tokens bigint").withColumn("_order", F.lit("x")).withColumn("available", F.lit(1))
    got = mixing.mix(df, ["b", "c"], {"c": {"k": 5}}, (2, 3), 2, 99).collect()
    rows = [(i, b, c, max(0, n or 0)) for i, b, c, n in rows]
    for leaf in {r[1:3] for r in rows}:
        mine = [r for r in rows if r[1:3] == leaf]
        drawn = [r for r in got if (r.b, r.c) == leaf]
        total = sum(r[3] for r in mine)
        epochs = drawn[0].epochs
        rest = sum(r.prefix_tokens for r in drawn)
        assert rest < total and all(r.epochs == epochs for r in drawn)
        want, left = {}, rest
        for r in sorted(mine, key=lambda r: (hashlib.md5(f"99:{epochs + 1}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0)):
            take = min(left, r[3])
            left -= take
            if r[0] != 3:  # repeated rows share their order in any way
                want[r[0]] = (take, epochs * r[3] + take)
        have = {r.doc_id: (r.prefix_tokens, r.drawn_tokens) for r in drawn if r.doc_id != 3}
        assert have == {i: v for i, v in want.items() if v[1] > 0}


def test_edges(spark, docs):
    empty = docs([]).withColumn("n_tokens", F.lit(1)).withColumn("s", F.lit("s"))
    assert mixing.mix(empty, ["s"], {}, (1, 1), 1, 0).collect() == []
    one = docs([(1, "a b"), (2, None)]).withColumn("n_tokens", mixing.words(F.col("text"))).withColumn("s", F.lit(None).cast("string"))
    assert [tuple(r) for r in mixing.mix(one, ["s"], {}, (3, 1), 2, 0).collect()] == [(1, None, 2, 2, 0, 4)]
