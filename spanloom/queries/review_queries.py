"""Interval and review queries on the derived publisher, detector and reference words."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import fixtures as fx
from spanloom.fixtures import millis, with_cte
from spanloom.operators import intervals as iv
from spanloom.operators import review as rv
from spanloom.queries import Registry

R = Registry()

SILENT = r"""
led AS (
  SELECT item_id, s, e, max(e) OVER (PARTITION BY item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM published WHERE e > s),
silent AS (
  SELECT item_id, coalesce(prev, 0) AS s, s AS e FROM led WHERE s > coalesce(prev, 0)
  UNION ALL
  SELECT i.item_id, coalesce(m.last, 0), i.audio_ms
  FROM items i LEFT JOIN (SELECT item_id, max(e) AS last FROM led GROUP BY item_id) m USING (item_id)
  WHERE i.audio_ms > coalesce(m.last, 0))"""

NORM = r"trim(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

MARKS = SILENT + r""",
cand AS (
  SELECT g.item_id, g.s, g.e, count(*) AS n, list({norm} ORDER BY d.s, d.e, d.seq) AS w, list(d.text ORDER BY d.s, d.e, d.seq) AS words
  FROM silent g JOIN detector d ON d.item_id = g.item_id AND d.s < g.e AND g.s < d.e
  WHERE g.e - g.s >= 800 GROUP BY ALL HAVING count(*) >= 2),
pb AS (SELECT *, {pnorm} AS norm, row_number() OVER (PARTITION BY item_id ORDER BY e, s, seq) AS rn,
         row_number() OVER (PARTITION BY item_id ORDER BY s, e, seq) AS rs FROM published p),
db AS (SELECT *, {dnorm} AS norm, row_number() OVER (PARTITION BY item_id ORDER BY e, s, seq) AS rn,
         row_number() OVER (PARTITION BY item_id ORDER BY s, e, seq) AS rs FROM detector d),
edges AS (
  SELECT c.*, (SELECT count(*) FROM pb WHERE pb.item_id = c.item_id AND pb.e <= c.s) AS pe,
    (SELECT count(*) FROM pb WHERE pb.item_id = c.item_id AND pb.s < c.e) AS ps,
    (SELECT count(*) FROM db WHERE db.item_id = c.item_id AND db.e <= c.s) AS de,
    (SELECT count(*) FROM db WHERE db.item_id = c.item_id AND db.s < c.e) AS ds
  FROM cand c),
sided AS (
  SELECT x.*,
    coalesce((SELECT list(norm ORDER BY rn) FROM pb WHERE pb.item_id = x.item_id AND rn <= pe AND rn > pe - n), []) AS b,
    coalesce((SELECT list(norm ORDER BY rs) FROM pb WHERE pb.item_id = x.item_id AND rs > ps AND rs <= ps + n), []) AS a,
    coalesce((SELECT list(norm ORDER BY rn) FROM db WHERE db.item_id = x.item_id AND rn <= de AND rn > de - n), []) AS dbw,
    coalesce((SELECT list(norm ORDER BY rs) FROM db WHERE db.item_id = x.item_id AND rs > ds AND rs <= ds + n), []) AS daw
  FROM edges x),
h0 AS (
  SELECT *, coalesce(list_max(list_filter(range(1, least(len(w), len(b)) + 1), lambda c:
      w[1:c] = b[len(b) - c + 1:len(b)] AND NOT list_contains(w[1:c], ''))), 0) AS hc FROM sided),
h1 AS (
  SELECT *, CASE WHEN hc > 0 AND len(dbw) >= hc AND w[1:hc] = dbw[len(dbw) - hc + 1:len(dbw)] THEN 0 ELSE hc END AS head FROM h0),
h2 AS (SELECT * EXCLUDE (w, words), w[head + 1:len(w)] AS w, words[head + 1:len(words)] AS words FROM h1),
t0 AS (
  SELECT *, coalesce(list_max(list_filter(range(1, least(len(w), len(a)) + 1), lambda c:
      w[len(w) - c + 1:len(w)] = a[1:c] AND NOT list_contains(w[len(w) - c + 1:len(w)], ''))), 0) AS tc FROM h2),
t1 AS (
  SELECT *, CASE WHEN tc > 0 AND len(daw) >= tc AND w[len(w) - tc + 1:len(w)] = daw[1:tc] THEN 0 ELSE tc END AS tail FROM t0),
marks AS (
  SELECT t1.item_id, row_number() OVER (PARTITION BY t1.item_id ORDER BY s) - 1 AS mark, s AS span_s, e AS span_e,
    greatest(0, s - 400) AS play_s, least(audio_ms, e + 400) AS play_e,
    len(w) - tail AS detector_words, array_to_string(words[1:len(words) - tail], ' ') AS detector_text
  FROM t1 JOIN items USING (item_id) WHERE len(w) - tail >= 2)""".format(
    norm=NORM.format("d.text"), pnorm=NORM.format("p.text"), dnorm=NORM.format("d.text")
)

EVALUATION = MARKS + r""",
dropped AS (
  SELECT r.* FROM ref_words r WHERE NOT EXISTS (
    SELECT 1 FROM published p WHERE p.item_id = r.item_id AND p.s < r.e AND r.s < p.e)),
covered AS (
  SELECT d.* FROM dropped d WHERE EXISTS (
    SELECT 1 FROM marks m WHERE m.item_id = d.item_id AND m.span_s < d.e AND d.s < m.span_e)),
spoken AS (
  SELECT m.* FROM marks m WHERE EXISTS (
    SELECT 1 FROM ref_words r WHERE r.item_id = m.item_id AND m.span_s < r.e AND r.s < m.span_e)),
mled AS (
  SELECT item_id, play_s, play_e, max(play_e) OVER (PARTITION BY item_id ORDER BY play_s, play_e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM marks),
counts AS (
  SELECT i.item_id, i.audio_ms,
    (SELECT count(*) FROM marks m WHERE m.item_id = i.item_id) AS marks,
    (SELECT count(*) FROM spoken m WHERE m.item_id = i.item_id) AS marks_on_speech,
    (SELECT count(*) FROM dropped m WHERE m.item_id = i.item_id) AS dropped_words,
    (SELECT count(*) FROM covered m WHERE m.item_id = i.item_id) AS dropped_covered,
    coalesce((SELECT sum(greatest(play_e - greatest(play_s, coalesce(prev, play_s)), 0)) FROM mled m WHERE m.item_id = i.item_id), 0) AS review_ms
  FROM items i)"""


def sources(spark, d):
    return fx.published(spark, d), fx.detector(spark, d), fx.items(spark, d)


@R.add("I3_silent_spans", with_cte("SELECT item_id, s AS start_ms, e AS end_ms FROM silent", SILENT))
def silent(spark, d):
    published, _, items = sources(spark, d)
    return rv.silent_spans(published, items).select("item_id", millis("start").alias("start_ms"), millis("end").alias("end_ms"))


@R.add(
    "R1_candidate_spans",
    with_cte(
        "SELECT g.item_id, g.s AS start_ms, g.e AS end_ms, count(*) AS detector_words FROM silent g JOIN detector d"
        " ON d.item_id = g.item_id AND d.s < g.e AND g.s < d.e WHERE g.e - g.s >= 800 GROUP BY ALL HAVING count(*) >= 2",
        SILENT,
    ),
)
def candidates(spark, d):
    spans = rv.candidate_spans(*sources(spark, d))
    return spans.select("item_id", millis("span_start").alias("start_ms"), millis("span_end").alias("end_ms"), F.col("n").alias("detector_words"))


@R.add(
    "R1_build_review",
    with_cte("SELECT item_id, mark, span_s, span_e, play_s, play_e, detector_words, detector_text FROM marks", MARKS),
)
def build_review(spark, d):
    return rv.build_review(*sources(spark, d)).select(
        "item_id", "mark", millis("span_start").alias("span_s"), millis("span_end").alias("span_e"),
        millis("start").alias("play_s"), millis("end").alias("play_e"), "detector_words", "detector_text",
    )


@R.add(
    "R3_evaluate_review",
    with_cte(
        """SELECT item_id, marks, marks_on_speech, dropped_words, dropped_covered, review_ms,
  CASE WHEN marks > 0 THEN round(marks_on_speech / marks::DOUBLE, 6) ELSE 0.0 END AS precision_,
  CASE WHEN dropped_words > 0 THEN round(dropped_covered / dropped_words::DOUBLE, 6) ELSE 0.0 END AS recall,
  round(review_ms / audio_ms::DOUBLE, 6) AS fraction FROM counts""",
        EVALUATION,
    ),
)
def evaluate(spark, d):
    published, detector, items = sources(spark, d)
    marks = rv.build_review(published, detector, items)
    return _evaluation(rv.evaluate_review(marks, published, fx.ref_words(spark, d), items))


def _evaluation(df):
    return df.select(
        "item_id", "marks", "marks_on_speech", "dropped_words", "dropped_covered",
        millis("audio_to_review_s").alias("review_ms"), F.round("precision", 6).alias("precision_"),
        F.round("recall", 6).alias("recall"), F.round("audio_to_review_fraction", 6).alias("fraction"),
    )
