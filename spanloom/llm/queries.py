"""Queries of the operators over the given tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spanloom.llm import audit, exact, fingerprints, language, lengths, lines, mixing, neighbours, pieces, repeats, runs, simhash, tokenids, warc
from spanloom.llm.common import settled, table
from spanloom.session import scratch
from spanloom.queries import Registry

R = Registry()
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@R.add("op1_sentencepiece")
def sentencepiece(spark, d):
    """Encoded and decoded again: ids, and whether the text came back."""
    docs = table(spark, d, "documents")
    back = pieces.round_trip(docs, PIECES)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.length("decoded").cast("bigint").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


@R.add("op2_fingerprints")
def document_fingerprints(spark, d):
    """Each text, and the text whose second half is replaced by the next document's beginning."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    docs = neighbours.with_next(docs, "doc_id", ["text", "_row"], ["text", "_row"])
    size, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("_edited", F.concat(F.substring("text", F.lit(1), size - half), F.substring("_next_text", F.lit(1), half)))
    about = F.struct("doc_id", size.cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("sha"), F.col("_next__row").alias("next"))
    both = F.array(F.struct(F.lit(0).alias("edited"), F.col("text").alias("text"), about.alias("about")), F.struct(F.lit(1).alias("edited"), F.col("_edited").alias("text"), F.lit(None).cast(docs.select(about.alias("a")).schema["a"].dataType).alias("about")))
    texts = docs.select("_bucket", "_row", F.explode(both).alias("_v")).select("_bucket", "_row", F.col("_v.edited").alias("_is_edited"), F.col("_v.about").alias("_about"), F.col("_v.text").alias("_text"))
    # Partitioned by _bucket, which is part of the keys: texts are not shuffled again.
    signed = fingerprints.signatures(texts, "_text", ["_bucket", "_row", "_is_edited", "_about"])
    # Both signatures of a text lie where it does. A number is one of 32 bits.
    both = [F.first(F.when(F.col("_is_edited") == k, F.transform("_signature", lambda v: (v - (1 << 31)).cast("int"))), ignorenulls=True).alias(c) for k, c in enumerate(("_own", "_other"))]
    signed = signed.groupBy("_bucket", "_row").agg(F.first("_about", ignorenulls=True).alias("_about"), *both)
    signed = settled(signed.drop("_bucket"), "fingerprints")
    # Joined alike at any size.
    after = signed.select(F.col("_row").alias("_next"), F.col("_own").alias("_after")).hint("merge")
    rows = signed.withColumn("_next", F.col("_about.next")).join(after, "_next")
    plain = {c: F.transform(c, lambda v: v.cast("bigint") + (1 << 31)) for c in ("_own", "_other", "_after")}
    rows = rows.withColumns(plain)
    return rows.select(
        F.col("_about.doc_id").alias("doc_id"),
        F.col("_about.n_chars").alias("n_chars"),
        F.col("_about.sha").alias("edited_sha256"),
        fingerprints.fingerprint(F.col("_own")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("_other")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        fingerprints.likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )


@R.add(
    "op3_exact_dedup",
    r"""
    WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM plain WINDOW w AS (PARTITION BY t)""",
)
def exact_dedup(spark, d):
    return exact.exact_dedup(table(spark, d, "documents"))


@R.add("op4_language_id")
def language_id(spark, d):
    return language.language_id(table(spark, d, "documents"))


@R.add("op5_token_ids")
def token_ids(spark, d):
    """Written and read back."""
    path = scratch(spark, "token-ids")
    tokenids.write_token_ids(table(spark, d, "documents"), TOKENIZER, path, END_ID)
    return tokenids.read_documents(spark, path)


@R.add("op6_repeats")
def repeated_passages(spark, d):
    return repeats.remove_repeats(table(spark, d, "documents")).drop("kept")


@R.add("op7_token_counts")
def token_counts(spark, d):
    counted = lengths.token_lengths(table(spark, d, "documents"), RANKS, public_tokenizers.PATTERN)
    return lengths.length_histogram(counted)


# The mix: a tree of domain, language and source, the domain given by the source's number.
TREE = ("domain", "lang", "source")
DOMAINS = ("web", "books", "code", "reference")
MIX_WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "reference": 1}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2}}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = (3, 5), 3, 17


def with_domain(docs):
    number = F.try_element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int"), F.lit(4)) + 1)
    return docs.withColumn("domain", F.coalesce(number, F.lit("other")))


@R.add(
    "op8_mixing",
    r"""
    WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
        coalesce((['web', 'books', 'code', 'reference'])[CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS INT) + 1], 'other') AS domain FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n) AS t, CAST(sum(n) * 3 AS DOUBLE) AS c,
        CAST(CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS DOUBLE) AS wd,
        CAST(CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS DOUBLE) AS wl,
        CAST(CASE source WHEN 'src0' THEN 2 ELSE 1 END AS DOUBLE) AS ws FROM d GROUP BY ALL),
    d0 AS (SELECT domain, sum(c) AS c, max(wd) AS w FROM leaf GROUP BY domain),
    d1 AS (SELECT *, (SELECT CAST(least((sum(t) * 3) // 5, sum(t) * 3) AS DOUBLE) FROM leaf) AS g FROM d0),
    d2 AS (SELECT *, (g - coalesce(sum(c) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM d1
        WINDOW b AS (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d3 AS (SELECT domain, least(c, w * max(lv) OVER ()) AS g FROM d2),
    l0 AS (SELECT domain, lang, sum(c) AS c, max(wl) AS w FROM leaf GROUP BY domain, lang),
    l2 AS (SELECT l0.*, (g - coalesce(sum(c) OVER b, 0)) / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER b, 0)) AS lv FROM l0 JOIN d3 USING (domain)
        WINDOW b AS (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l3 AS (SELECT domain, lang, least(c, w * max(lv) OVER (PARTITION BY domain)) AS g FROM l2),
    s2 AS (SELECT leaf.*, (g - coalesce(sum(c) OVER b, 0)) / (sum(ws) OVER (PARTITION BY domain, lang) - coalesce(sum(ws) OVER b, 0)) AS lv
        FROM leaf JOIN l3 USING (domain, lang)
        WINDOW b AS (PARTITION BY domain, lang ORDER BY c / ws, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s3 AS (SELECT domain, lang, source, CAST(t AS BIGINT) AS t, CAST(floor(least(c, ws * max(lv) OVER (PARTITION BY domain, lang))) AS BIGINT) AS a FROM s2),
    o AS (SELECT doc_id, domain, lang, source, n, a // t AS epochs, a % t AS r, md5('17:' || (a // t + 1) || ':' || doc_id) AS k FROM d JOIN s3 USING (domain, lang, source)),
    p AS (SELECT *, greatest(0, least(n, r - coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM o)
    SELECT doc_id, domain, lang, source, n AS n_tokens, epochs, CAST(take AS BIGINT) AS prefix_tokens, CAST(epochs * n + take AS BIGINT) AS drawn_tokens FROM p
    WHERE epochs * n + take > 0""",
)
def mixing_sources(spark, d):
    docs = with_domain(table(spark, d, "documents")).withColumn("n_tokens", mixing.words(F.col("text")))
    return mixing.mix(docs, TREE, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


@R.add(
    "op9_line_dedup",
    r"""
    WITH parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
    keyed AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts),
    shared AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    marked AS (SELECT k.*, coalesce(k.doc_id <> s.last_doc, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def line_dedup(spark, d):
    return lines.line_dedup(table(spark, d, "documents")).select("_doc.doc_id", "n_lines", "n_dropped", "kept_sha256")


@R.add("op10_simhash")
def simhash_dedup(spark, d):
    return simhash.simhash_groups(table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


@R.add(
    "op11_filter_audit",
    r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    m AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS fails FROM d),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
        count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY part, fails),
    f AS (SELECT unnest(range(5)) AS k),
    o AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, e.k AS e FROM f a, f b, f c, f d, f e
        WHERE (1 << a.k) + (1 << b.k) + (1 << c.k) + (1 << d.k) + (1 << e.k) = 31),
    s AS (SELECT chr(CAST(65 + a AS INT)) || chr(CAST(65 + b AS INT)) || chr(CAST(65 + c AS INT)) || chr(CAST(65 + d AS INT)) || chr(CAST(65 + e AS INT)) AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
        unnest([a, b, c, d, e]) AS k, unnest([0, 1 << a, (1 << a) + (1 << b), (1 << a) + (1 << b) + (1 << c), (1 << a) + (1 << b) + (1 << c) + (1 << d)]) AS before FROM o),
    r AS (SELECT part, filter_order, step, k,
        CAST(sum(n) FILTER (WHERE fails & (before | (1 << k)) = 0) AS BIGINT) AS kept,
        CAST(sum(n) FILTER (WHERE fails & before = 0 AND fails & (1 << k) <> 0) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (WHERE fails & before <> 0 AND fails & (1 << k) <> 0) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (WHERE fails = 1 << k) AS BIGINT) AS unique_fails,
        CAST(sum(good) FILTER (WHERE fails & before = 0 AND fails & (1 << k) <> 0) AS BIGINT) AS good_lost,
        CAST(sum(toxic) FILTER (WHERE fails & before = 0 AND fails & (1 << k) <> 0) AS BIGINT) AS toxic_lost
        FROM c, s GROUP BY part, filter_order, step, k)
    SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
      coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley FROM r""",
)
def filter_audit(spark, d):
    return audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


@R.add(
    "op12_warc",
    r"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS head FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
      CASE WHEN n >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 100 AND page_id <> head THEN head END AS refers_to
    FROM q""",
)
def warc_records(spark, d):
    """Written, and read back by the whole index. What a response says is worked out of its payload."""
    folder = scratch(spark, "warc")
    index = warc.write_archives(table(spark, d, "pages"), folder)
    records = warc.read_records(index, folder)
    return records.select(
        F.col("record_key").cast("bigint").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def with_period(doc_id, text):
    """The text of every tenth document by crc32 of its id, with a tail that repeats its beginning."""
    crc = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(crc / 10).cast("bigint")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeats = F.ceil((n - a) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), repeats)), F.lit(1), n - a)
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((crc % 10 == 0) & (n > 0), edited).otherwise(text)


@R.add("op13_periodic_runs")
def periodic_runs(spark, d):
    docs = table(spark, d, "documents")
    docs = docs.select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.collapse_runs(docs).withColumn("_best", runs.longest_run(F.col("runs")))
    lines_of = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines_of, lambda s: F.concat(s, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
