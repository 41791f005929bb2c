"""A training corpus from documents: five stages, each from a DataFrame of documents to the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language, lines, mixing, pieces, shingles, simhash
from spanloom.llm.common import ready, settled
from spanloom.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, TREE, with_domain

# Text whose best language still needs a phrase for every two bytes is in none of the languages.
# Of shorter texts this says nothing: one letter is a phrase in one byte, so they stay.
MAX_PHRASES_PER_BYTE, LEAST_BYTES = 0.5, 64
# As many tokens as there are, dealt out anew by the weights.
MIX_BUDGET = (1, 1)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with `lang` as predicted. Documents without a letter, or
    of LEAST_BYTES or more and like none of the languages, go."""
    found = language.identify(docs.select("text", F.struct(*docs.columns).alias("_row")), language.learn(docs))
    judged = F.octet_length("_row.text") >= LEAST_BYTES
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (~judged | (F.col("phrases_per_byte") <= MAX_PHRASES_PER_BYTE)))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"_row.{c}") for c in docs.columns])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more share; the last of these keeps them. A null
    text is one empty line and stays null, rows that repeat a doc_id are one document and are cut
    alike, an empty table gives no rows, and other columns stay as they are."""
    found = lines.line_dedup(docs, keep=True)
    new = {"text": F.col("text"), "n_chars": F.length(F.coalesce("text", F.lit(""))).cast("bigint")}
    return found.select(*[new.get(c, F.col(f"_doc.{c}")).alias(c) for c in docs.columns])


def numbered_rows(docs: DataFrame) -> DataFrame:
    """_doc, _row, written once: numbers derived again in a later job differ if the files are split
    otherwise there."""
    return settled(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; a null doc_id is larger
    than any other, and of rows that repeat one the first stays. Documents link by operator 10 (SimHash
    fingerprints of at most four differing bits), or by an exact similarity of 0.8 or more of their
    shingles of five words, which finds near copies that fingerprints hold apart; a group is what either
    kind of link reaches. Texts without words, null and empty ones among them, are one group. An empty
    table gives no rows."""
    numbered = numbered_rows(docs)
    rows = numbered.select("_row", "_doc.doc_id", "_doc.text")
    near, similar = simhash.simhash_groups(rows), shingles.shingle_groups(rows)
    linked = near.select("_row", "component_row").unionByName(similar.select("_row", "component_row"))
    members = settled(simhash.components(linked.filter("_row <> component_row").select(F.col("_row").alias("a"), F.col("component_row").alias("b"))), "near-members")
    # Each row of a group but the smallest; the root itself has no row in `members`.
    whole = members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    placed = settled(rows.select("_row", "doc_id").join(whole, F.col("_row") == F.col("node")).select("root", place.alias("place")), "near-places")
    firsts = placed.groupBy("root").agg(F.min("place").alias("first"))
    gone = placed.join(firsts, "root").filter("place._row <> first._row").select(F.col("place._row").alias("_gone"))
    return numbered.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them. A document in which a leaf's last epoch ends is
    taken whole. Texts without words, null and empty ones among them, have no tokens to read and are
    not drawn; rows that repeat are documents of their own; null langs and sources are leaves like
    others. An empty table gives no rows."""
    numbered = numbered_rows(docs)
    rows = with_domain(numbered.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.lang").alias("lang"), F.col("_doc.source").alias("source"), mixing.words(F.col("_doc.text")).alias("n_tokens")))
    drawn = mixing.mix(rows, TREE, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED, keys=("doc_id", "_row"))
    times = (F.col("epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0)).cast("int")
    drawn = drawn.select("_row", F.explode(F.array_repeat(F.lit(0), times)).alias("_again")).select("_row")
    return numbered.join(drawn, "_row").select("_doc.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text: doc_id, lang, source, n_ids, ids and
    round_trip, which is all that `docs` is read for besides its text. Null and empty texts have no
    ids; a row that repeats is encoded again; an empty table gives no rows."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    back = pieces.round_trip(rows, path, keep=("doc_id", "lang", "source", "_sha"))
    return back.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Language, fingerprints and pieces are beyond SQL; tests/llm/test_llm_pipeline.py runs the stages
# against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each stage's result is written to the shared folder and read
    again as the next one's documents."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
