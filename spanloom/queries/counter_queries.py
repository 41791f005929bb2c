"""Counters and flags over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.fixtures import table
from spanloom.functions import text as tx
from spanloom.operators import catalog as ct
from spanloom.operators import counters as cn
from spanloom.queries import Registry
from spanloom.session import scratch, settle
from spanloom.sources import files as fl

R = Registry()


@R.add(
    "T23_approximate_word_times",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN true ELSE false END AS approximate FROM lineitem""",
)
def t23(spark, d):
    n = F.col("l_linenumber") % 3
    timing = F.when(n == 0, "segment").when(n == 1, "token")
    facts = F.when(F.col("l_linenumber") != 5, F.to_json(F.struct(F.col("l_returnflag").alias("engine"), timing.alias("word_timing"))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cn.approximate_word_times(facts).alias("approximate"))


@R.add(
    "A12_transcript_counters",
    r"""WITH t AS (SELECT conv_id, length(text) AS n, len(list_filter(string_split_regex(replace(regexp_replace(replace(translate(lower(text), '’‘_', ''''' '), '''', chr(1)), '\p{P}', '', 'g'), chr(1), ''''), '\s+'), lambda x: x <> '')) AS w FROM conversations)
SELECT conv_id AS item_id, count(*) AS segments, CAST(sum(w) AS BIGINT) AS words, count(*) FILTER (WHERE w = 0) AS empty_segments, CAST(sum(n) AS BIGINT) AS chars FROM t GROUP BY conv_id""",
)
def a12(spark, d):
    segments = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.lit(0.0).alias("start"), F.length("text").cast("double").alias("end"), "text")
    return cn.transcript_counters(segments).withColumn("chars", F.col("speech_s").cast("bigint")).drop("speech_s")


@R.add(
    "A10_non_speech_totals",
    """WITH k AS (SELECT user_id, event_type, CAST(sum(round(value * 100)) AS BIGINT) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT e.user_id AS item_id, (SELECT string_agg(event_type || '=' || c, ',' ORDER BY event_type) FROM k WHERE k.user_id = e.user_id) AS kinds,
  count(*) FILTER (WHERE event_id % 7 = 0) AS suppressed_publisher_words, count(*) FILTER (WHERE event_id % 7 = 1) AS suppressed_detector_words,
  coalesce(bool_or(event_id % 11 = 0), false) AS tagged FROM events e GROUP BY e.user_id""",
)
def a10(spark, d):
    events = table(spark, d, "events").withColumn("item_id", F.col("user_id"))
    scenes = events.where("value IS NOT NULL").select("item_id", F.col("event_type").alias("kind"), F.lit(0.0).alias("start"), F.round(F.col("value") * 100).alias("end"))
    source = F.when(F.col("event_id") % 7 == 0, "publisher").when(F.col("event_id") % 7 == 1, "detector")
    out = cn.non_speech_totals(events.select("item_id").distinct(), scenes, events.select("item_id", source.alias("source")), events.where("event_id % 11 = 0"))
    kinds = F.array_join(F.transform(F.map_entries("seconds_by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))), ",")
    return out.withColumn("kinds", F.when(F.size("seconds_by_kind") > 0, kinds)).drop("seconds_by_kind")


# The last class and text of a failed order, by ship date, then class and text.
OUTCOMES = """o AS (SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'cancelled' END AS status FROM orders),
l AS (SELECT l_orderkey AS path, l_returnflag AS c, l_linestatus || l_linenumber AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_returnflag DESC, l_linestatus || l_linenumber DESC) AS n FROM lineitem),
rows AS (SELECT o.path, status, c AS error_class, e AS error FROM o LEFT JOIN l ON l.path = o.path AND n = 1 AND status = 'failed')"""


def order_outcomes(spark, d):
    """Orders as sources: status O finished; those of status F failed once per line, the last counts."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus")
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("error_class"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("error"), F.col("l_shipdate").alias("at")
    )
    failures = lines.join(orders.where("o_orderstatus = 'F'").select("path"), "path", "left_semi")
    return ct.outcomes(orders.select("path"), orders.where("o_orderstatus = 'O'"), failures)


@R.add(
    "K8_batch_rows",
    f"""WITH {OUTCOMES} SELECT 'b1' AS batch, 'standard' AS profile, path, CASE WHEN status = 'failed' AND error_class IS NULL THEN 'cancelled' ELSE status END AS status, error_class, error FROM rows""",
)
def k8(spark, d):
    return cn.batch_rows(order_outcomes(spark, d), "b1", "standard")


@R.add(
    "K8_batch_record",
    f"""WITH {OUTCOMES}, s AS (SELECT *, CASE WHEN status = 'failed' AND error_class IS NULL THEN 'cancelled' ELSE status END AS st, path % 3 AS b FROM rows)
SELECT 'b/' || b AS batch, 'standard' AS profile, CAST(b AS INTEGER) AS speakers, 0.5::DOUBLE AS threshold, count(*) FILTER (st = 'ok') AS n_ok, count(*) FILTER (st = 'failed') AS n_failed,
  count(*) FILTER (st = 'cancelled') AS n_cancelled, sha256(coalesce(string_agg(path || ':' || error_class || ':' || error, ',' ORDER BY path) FILTER (st = 'failed'), '')) AS failures FROM s GROUP BY b""",
)
def k8_record(spark, d):
    """Three batches, written and read back, with their failures. The first is written twice."""
    path = scratch(spark, "batches")
    rows = settle(order_outcomes(spark, d).withColumn("path", F.col("path").cast("string")))
    for number in (0, 0, 1, 2):
        mine = rows.where(F.col("path").cast("bigint") % 3 == number)
        fl.write_batch(mine, path, f"b/{number}", {"profile": "standard", "speakers": number, "threshold": 0.5})
    batches, stored = fl.read_batches(spark, path)
    line = F.struct(F.col("path").cast("bigint").alias("p"), F.concat_ws(":", "path", "error_class", "error").alias("t"))
    listed = ct.failed(stored).groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), ",").alias("t"))
    out = batches.join(listed, "batch", "left")
    return out.select("batch", "profile", "speakers", "threshold", "n_ok", "n_failed", "n_cancelled", F.sha2(F.coalesce("t", F.lit("")), 256).alias("failures"))


@R.add(
    "T7_respell",
    r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word,
    unnest(range(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')))) AS pos FROM conversations),
m AS (SELECT *, CASE WHEN length(word) % 3 = 0 THEN reverse(word) ELSE word END AS r FROM w)
SELECT c.conv_id, c.turn, md5(coalesce((SELECT string_agg(r, ' ' ORDER BY pos) FROM m WHERE m.conv_id = c.conv_id AND m.turn = c.turn), '')) AS digest FROM conversations c""",
)
def t7(spark, d):
    """Every third length of word has another spelling."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    words = rows.select(F.explode(F.split("text", r"(?U)\s+")).alias("word")).where("length(word) % 3 = 0 AND word <> ''").distinct()
    spelled = tx.respell(rows, "text", words.withColumn("respelled", F.reverse("word")), ["conv_id", "turn"])
    return spelled.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))
