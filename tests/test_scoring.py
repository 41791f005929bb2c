"""Hand fixtures for alignment and timeline scoring, and the kernel against brute force."""

import random

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import align as al
from spanloom.operators import timeline as tl
from spanloom.plans import report as rp


def brute(ref, hyp):
    n, m = len(ref), len(hyp)
    cost = [[i + j if not (i and j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = n, m, []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            out.append((0, i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out.append((1, i - 1, -1))
            i -= 1
        else:
            out.append((2, -1, j - 1))
            j -= 1
    return cost[n][m], out[::-1]


def test_trace_keeps_the_tie_order():
    rng = random.Random(1)
    for _ in range(400):
        kinds = rng.choice([2, 3, 8])
        a = [str(rng.randrange(kinds)) for _ in range(rng.randrange(60))]
        b = [str(rng.randrange(kinds)) for _ in range(rng.randrange(60))]
        d, steps = brute(a, b)
        k, i, j = al.trace(a, b)
        assert list(zip(k.tolist(), i.tolist(), j.tolist())) == steps
        assert al.distance(a, b) == d


def test_word_errors_and_recall(spark):
    ref = "the quick brown fox jumps over the lazy dog".split()
    hyp = "the quack brown jumps over the lazy big dog".split()
    pairs = spark.createDataFrame([(1, "v", ref, hyp), (2, "v", ["a"], ["a"]), (3, "v", [], ["x"]), (4, "v", [], [])], "item_id long, variant string, ref array<string>, hyp array<string>")
    ops = al.edit_ops(pairs)
    rows = {r.item_id: r for r in al.word_errors(pairs, ops).collect()}
    r = rows[1]
    assert (r.n_ref, r.n_hyp, r.hits, r.sub, r.dele, r.ins) == (9, 9, 7, 1, 1, 1) and abs(r.wer - 3 / 9) < 1e-12
    assert rows[2].wer == 0.0 and rows[3].wer is None and rows[4].wer == 0.0
    speakers = spark.createDataFrame([(1, i, "a" if i < 4 else "b") for i in range(9)], "item_id long, ref_at long, speaker string")
    recall = {r.speaker: r for r in al.per_speaker_recall(ops, speakers).collect()}
    assert (recall["a"].recovered, recall["a"].substituted, recall["a"].deleted) == (2, 1, 1)
    assert recall["b"].recovered == 5
    cer = {r.item_id: r.cer for r in al.cer_chunked(pairs, ops).collect()}
    assert cer[2] == 0.0 and cer[3] == float("inf") and cer[4] == 0.0
    whole = pairs.where("item_id = 1").select(al.token_distance().alias("d"), al.token_distance(native_tokens=0).alias("k")).first()
    assert (whole.d, whole.k) == (3, 3)


def segs(spark, rows):
    return spark.createDataFrame(rows, "item_id long, start double, end double, label string")


def test_diarization_fixtures(spark):
    ref = segs(spark, [
        (1, 0.0, 10.0, "A"), (1, 10.0, 20.0, "B"), (1, 25.0, 30.0, "A"),
        (2, 0.0, 10.0, "A"), (2, 10.0, 20.0, "B"), (2, 20.0, 25.0, "C"),
        (3, 0.0, 10.0, "A"), (3, 10.0, 20.0, "B"),
        (4, 0.0, 10.0, "A"), (4, 5.0, 15.0, "B"),
        (5, 0.0, 100.0, "A"), (5, 100.0, 200.0, "B"), (5, 200.0, 300.0, "C"), (5, 300.0, 310.0, "D"),
    ])
    hyp = segs(spark, [
        (1, 0.0, 10.0, "B"), (1, 10.0, 20.0, "A"), (1, 25.0, 30.0, "B"),
        (2, 0.0, 10.0, "x"), (2, 10.0, 20.0, "y"),
        (3, 0.0, 10.0, "p"), (3, 10.0, 16.0, "q"), (3, 16.0, 20.0, "r"),
        (4, 0.0, 10.0, "a"), (4, 10.0, 15.0, "b"),
        (5, 0.0, 100.0, "h1"), (5, 100.0, 150.0, "h2"), (5, 150.0, 152.0, "h4"), (5, 152.0, 200.0, "h2"), (5, 200.0, 310.0, "h3"),
        (6, 0.0, 5.0, "z"),
    ])
    rows = {r.item_id: r for r in tl.diarization_errors(ref, hyp, (0.0,)).collect()}
    assert rows[1].der == 0.0 and rows[1].scored_ref_s == 25.0
    assert abs(rows[2].miss - 0.2) < 1e-12 and rows[2].unmatched_ref == ["C"] and abs(rows[2].jer - 1 / 3) < 1e-12
    assert rows[3].mapping == {"A": "p", "B": "q"} and abs(rows[3].confusion - 0.2) < 1e-12 and abs(rows[3].jer - 0.2) < 1e-12
    assert rows[4].scored_ref_s == 20.0 and abs(rows[4].miss - 0.25) < 1e-12
    assert abs(rows[5].der - 12 / 310) < 1e-12 and rows[5].unmatched_ref == ["D"] and abs(rows[5].jer - 0.2777) < 1e-3
    assert rows[6].der == float("inf") and rows[6].jer == 0.0
    skipping = {r.item_id: r for r in tl.diarization_errors(ref, hyp, (0.0,), skip_overlap=True).collect()}
    assert skipping[4].scored_ref_s == 10.0 and skipping[4].der == 0.0


def test_collar(spark):
    ref, hyp = segs(spark, [(1, 5.0, 15.0, "A")]), segs(spark, [(1, 4.9, 15.1, "a")])
    rows = {r.collar: r for r in tl.diarization_errors(ref, hyp, (0.0, 0.25)).collect()}
    assert abs(rows[0.0].false_alarm - 0.02) < 1e-9 and rows[0.25].der == 0.0


def test_fold_labels(spark):
    turns = segs(spark, [(1, 20.0 * i, 20.0 * i + 10 - i, f"s{i}") for i in range(8)])
    rows = tl.fold_labels(turns, 3).collect()
    assert {r.label for r in rows} == {"s0", "s1", "other"} and rows[0].found == 8 and "6 smallest" in rows[0].note


def test_rows_of_bits_give_the_steps_of_the_full_table():
    """Ties too, in one block of rows and in several."""
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        n, m = len(a), len(b)
        table = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                table[i][j] = min(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
        bits = al.BitRows(b)
        row, i, j, want = bits.first(), n, m, []
        for k, token in enumerate(a):
            assert bits.costs(*row, k).tolist() == table[k]
            row = bits.next(*row, token)[:2]
        while i or j:
            if i and j and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                want.append((al.DIAGONAL, i, j))
            elif i and (not j or table[i][j] == table[i - 1][j] + 1):
                i -= 1
                want.append((al.DELETE, i, -1))
            else:
                j -= 1
                want.append((al.INSERT, -1, j))
        for al.KEPT_BITS in (1, 1 << 27):
            assert list(zip(*(x.tolist() for x in al.trace(a, b)))) == want[::-1]
        assert al.distance(a, b) == table[n][m]


def test_scores_read_settled_tokens(spark):
    """Recall reads the positions of the reference's tokens that the pairs were made of; they are not counted again."""
    said = [(1, i, i * 1.0, i + 0.5, w, "ab"[i % 2]) for i, w in enumerate(["one", "Two.", "three", "don't"])]
    reference = spark.createDataFrame(said, "item_id long, seq long, start double, end double, text string, speaker string")
    words = reference.drop("speaker").withColumn("variant", F.lit("publisher")).where("seq <> 2")
    scores = rp.transcript_scores(reference, words)
    plan = scores["recall"]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "__from" not in plan
    assert sorted((r.speaker, r.n_tokens, r.recovered) for r in scores["recall"].collect()) == [("a", 2, 1), ("b", 3, 3)]
    assert [(r.n, r.median_abs_s) for r in scores["timing"].collect()] == [(3, 0.0)]


def test_words_without_white_space(spark):
    """Texts that are one word are not split; every other text is, at any white space."""
    texts = ["", " ", "one", "a b", "a  b", "a\u0085b c", "  two words ", "é", None, "\t", "it's\tso\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(tx.tokenize_raw("x")).collect()]
    assert got == [[], [], ["one"], ["a", "b"], ["a", "b"], ["a", "b", "c"], ["two", "words"], ["é"], None, [], ["it's", "so"]]
