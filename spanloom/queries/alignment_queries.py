"""What is counted on the edit operations of the benchmark texts, with the edit table as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.fixtures import table
from spanloom.operators import align as al
from spanloom.queries import Registry
from spanloom.queries.scoring_queries import TABLE, benchmark_pairs
from spanloom.session import settle

R = Registry()
KEYS = ("item_id", "variant")

# Steps in order with their tokens, and the stretches between runs of five equal steps.
STEPS = (
    TABLE
    + """,
ops0 AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY step DESC) - 1 AS op_seq, kind,
    CASE WHEN kind <> 'ins' THEN ri - 1 END AS ref_at, CASE WHEN kind <> 'del' THEN hj - 1 END AS hyp_at FROM walk WHERE step > 0),
ops1 AS (
  SELECT o.*, p.ref[ref_at + 1] AS ref_token, p.hyp[hyp_at + 1] AS hyp_token,
    (o.kind = 'equal') IS DISTINCT FROM (lag(o.kind) OVER (PARTITION BY item_id ORDER BY op_seq) = 'equal') AS turn FROM ops0 o JOIN pairs p USING (item_id)),
ops2 AS (SELECT *, sum(turn::INT) OVER (PARTITION BY item_id ORDER BY op_seq) AS run FROM ops1),
ops3 AS (SELECT *, kind = 'equal' AND count(*) OVER (PARTITION BY item_id, run) >= 5 AS anchor FROM ops2),
ops4 AS (SELECT *, NOT anchor AND coalesce(lag(anchor) OVER (PARTITION BY item_id ORDER BY op_seq), true) AS opens FROM ops3),
ops AS (SELECT *, CASE WHEN NOT anchor THEN sum(opens::INT) OVER (PARTITION BY item_id ORDER BY op_seq) - 1 END AS chunk FROM ops4),
counts AS (
  SELECT item_id, len(p.ref) AS n_ref, len(p.hyp) AS n_hyp, count(*) FILTER (WHERE kind = 'equal') AS hits, count(*) FILTER (WHERE kind = 'sub') AS sub,
    count(*) FILTER (WHERE kind = 'del') AS dele, count(*) FILTER (WHERE kind = 'ins') AS ins FROM ops JOIN pairs p USING (item_id) GROUP BY item_id, p.ref, p.hyp)"""
)
# DuckDB's levenshtein counts bytes; capitals stand for the accented letters of lower-cased text.
PLAIN = "translate({}, 'àáâäçèéêëíîïñóôöùúûüß', 'ABCDEFGHIJKLMNOPQRSTU')"
POOLED = "sum(n_ref)::BIGINT AS n_ref, sum(n_hyp)::BIGINT AS n_hyp, sum(hits)::BIGINT AS hits, sum(sub)::BIGINT AS sub, sum(dele)::BIGINT AS dele, sum(ins)::BIGINT AS ins, count(*) AS items, round(sum(sub + dele + ins) / sum(n_ref), 6) AS wer"


def steps(spark, d):
    pairs = settle(benchmark_pairs(spark, d))
    return pairs, settle(al.edit_ops(pairs))


def grouped(spark, d):
    pairs, ops = steps(spark, d)
    return al.word_errors(pairs, ops).withColumn("group", F.concat(F.lit("g"), (F.col("item_id") % 3).cast("string")))


@R.add("W8_anchored_chunks", f"WITH RECURSIVE {STEPS} SELECT item_id, op_seq, chunk::BIGINT AS chunk, ref_token, hyp_token FROM ops")
def w8(spark, d):
    return steps(spark, d)[1].select("item_id", "op_seq", "chunk", "ref_token", "hyp_token")


@R.add("Q3_text_errors", f"WITH RECURSIVE {STEPS} SELECT item_id, n_ref, n_hyp, hits, sub, dele, ins, round((sub + dele + ins) / n_ref, 6) AS wer FROM counts")
def q3(spark, d):
    return al.word_errors(*steps(spark, d)).drop("variant").withColumn("wer", F.round("wer", 6))


@R.add(
    "Q4_text_cer",
    f"""WITH RECURSIVE {STEPS},
sides AS (SELECT item_id, chunk, coalesce(string_agg(ref_token || ' ', '' ORDER BY op_seq), '') AS r, coalesce(string_agg(hyp_token || ' ', '' ORDER BY op_seq), '') AS h FROM ops WHERE chunk IS NOT NULL GROUP BY ALL),
errors AS (SELECT item_id, sum(levenshtein({PLAIN.format('r')}, {PLAIN.format('h')})) AS n FROM sides GROUP BY item_id)
SELECT item_id, round(coalesce(n, 0) / length(array_to_string(ref, ' ')), 6) AS cer FROM pairs LEFT JOIN errors USING (item_id)""",
)
def q4(spark, d):
    return al.cer_chunked(*steps(spark, d)).select("item_id", F.round("cer", 6).alias("cer"))


@R.add(
    "Q5_text_recall",
    f"""WITH RECURSIVE {STEPS} SELECT item_id, 'voice' || (ref_at // 7) % 3 AS speaker, count(*) AS n_tokens, count(*) FILTER (WHERE kind = 'equal') AS recovered,
  count(*) FILTER (WHERE kind = 'sub') AS substituted, count(*) FILTER (WHERE kind = 'del') AS deleted, min(ref_at) AS first_at,
  round(count(*) FILTER (WHERE kind = 'equal') / count(*), 6) AS recall FROM ops WHERE ref_at IS NOT NULL GROUP BY 1, 2""",
)
def q5(spark, d):
    pairs, ops = steps(spark, d)
    voices = pairs.select("item_id", F.posexplode("ref").alias("at", "t")).select(
        "item_id", F.col("at").cast("long").alias("ref_at"), F.concat(F.lit("voice"), (F.floor(F.col("at") / 7) % 3).cast("string")).alias("speaker")
    )
    return al.per_speaker_recall(ops, voices).drop("variant").withColumn("recall", F.round("recall", 6))


@R.add(
    "Q6_text_offsets",
    f"""WITH RECURSIVE {STEPS},
t AS (SELECT item_id, abs((hyp_at * 0.5::DOUBLE + (hyp_at % 5) * 0.125::DOUBLE) - ref_at * 0.5::DOUBLE) AS x FROM ops WHERE kind = 'equal')
SELECT item_id, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median_abs_s, round(quantile_cont(x, 0.9), 6) AS p90_abs_s FROM t GROUP BY item_id""",
)
def q6(spark, d):
    """Onsets half a second apart; the hypothesis lags by an eighth of a second a place, up to four."""
    pairs, ops = steps(spark, d)
    ref = pairs.select("item_id", F.posexplode("ref").alias("at", "t")).select("item_id", F.col("at").cast("long").alias("ref_at"), (F.col("at") * 0.5).alias("start"))
    hyp = pairs.select("item_id", "variant", F.posexplode("hyp").alias("at", "t"))
    hyp = hyp.select("item_id", "variant", F.col("at").cast("long").alias("hyp_at"), (F.col("at") * 0.5 + F.col("at") % 5 * 0.125).alias("start"))
    out = al.timing(al.timestamp_offsets(ops, ref, hyp)).drop("variant")
    return out.withColumns({c: F.round(c, 6) for c in ("median_abs_s", "p90_abs_s")})


@R.add("A7_text_pooled", f"""WITH RECURSIVE {STEPS} SELECT 'g' || item_id % 3 AS "group", {POOLED} FROM counts GROUP BY 1""")
def a7(spark, d):
    return al.pooled_word_errors(grouped(spark, d), ["group"]).withColumn("wer", F.round("wer", 6))


@R.add(
    "A16_text_subtotals",
    f"""WITH RECURSIVE {STEPS}, g AS (SELECT *, 'g' || item_id % 3 AS "group", 'spoiled' AS variant FROM counts)
SELECT "group", variant, {POOLED}, grouping("group", variant)::BIGINT AS level FROM g GROUP BY ROLLUP ("group", variant)""",
)
def a16(spark, d):
    return al.pooled_with_subtotals(grouped(spark, d)).withColumns({"wer": F.round("wer", 6), "level": F.col("level").cast("bigint")})


@R.add(
    "A13_quantiles",
    """SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS q0, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 4) AS q1,
  round(quantile_cont(l_extendedprice::DOUBLE, 0.999), 4) AS q2 FROM lineitem GROUP BY 1""",
)
def a13(spark, d):
    """Quantiles of a few groups that hold all rows."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("x"))
    found = al.exact_quantiles(rows, "x", (0.5, 0.9, 0.999), ["flag"])
    return found.withColumns({c: F.round(c, 4) for c in ("q0", "q1", "q2")})


@R.add(
    "Q4_character_distance",
    f"""SELECT a.item_id, levenshtein({PLAIN.format('lower(a.text)')}, {PLAIN.format('lower(b.text)')})::BIGINT AS distance FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""",
)
def text_distances(spark, d):
    """Neighbouring texts by the bit-parallel kernel."""
    texts = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("text"))
    after = texts.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return texts.join(after, "item_id").select("item_id", al.text_distance("text", "next", 1).alias("distance"))
