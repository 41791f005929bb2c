"""Token counts as an exact histogram of encoded lengths.

Documents are reduced to one row per encoded length. Suffix sums over that histogram answer, for
every context limit, how many documents are longer, how many tokens all documents have when they
are cut there, and which length holds a given share of the documents or tokens. The sums are taken
in two steps (blocks of lengths, then inside a block), so no task reads the whole histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import batch_of, pieces, ready, settled, strings

BLOCK = 256


def _counts(ranks_file: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        schema = pa.schema([("n_tokens", pa.int64())])
        for batch in pieces(batches, "text"):
            yield batch_of(schema, [len(encode(text)) for text in strings(batch, "text")])

    return run


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """n_tokens of every text (null is empty), by a byte-level BPE given as a rank file and a split
    pattern. The file is read once here and travels with the tasks."""
    ready(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        ranks_file = file.read()
    return docs.select("text").mapInArrow(_counts(ranks_file, pattern), "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From n_tokens per document (null counts as 0), one row per length that occurs:

    n_tokens, docs, docs_at_most, docs_longer (suffix sum), tokens_at_most, tokens_longer (suffix
    sum), truncated_tokens (total when every document is cut at n_tokens), docs_share (share of the
    documents of at most this length), tokens_total. An empty table gives no rows."""
    size = F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0))
    # Settled: it is read twice, and the texts should be encoded once.
    bars = settled(lengths.select(size.alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    bars = bars.withColumns({"_block": F.floor(F.col("n_tokens") / BLOCK).cast("bigint"), "_tokens": F.col("n_tokens") * F.col("docs")})
    blocks = bars.groupBy("_block").agg(F.sum("docs").alias("_docs"), F.sum("_tokens").alias("_block_tokens"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_block_tokens").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(every).alias("_docs_total"),
        F.sum("_block_tokens").over(every).alias("tokens_total"),
    )
    longer = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = bars.join(blocks, "_block").withColumns(
        {
            "docs_longer": F.coalesce(F.sum("docs").over(longer), F.lit(0)) + F.col("_docs_after"),
            "tokens_longer": F.coalesce(F.sum("_tokens").over(longer), F.lit(0)) + F.col("_tokens_after"),
        }
    )
    return rows.select(
        "n_tokens",
        "docs",
        (F.col("_docs_total") - F.col("docs_longer")).alias("docs_at_most"),
        "docs_longer",
        (F.col("tokens_total") - F.col("tokens_longer")).alias("tokens_at_most"),
        "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("_docs_total") - F.col("docs_longer")) / F.col("_docs_total")).alias("docs_share"),
        "tokens_total",
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of `limits` (context_limit): docs_longer and truncated_tokens at that limit,
    which need not be a length that occurs. The histogram's rows are compared as ranges: limit
    L is answered by the largest length up to L, found by a group-by over the pairs of blocks."""
    bars = histogram.select("n_tokens", "tokens_at_most", "docs_longer")
    docs = histogram.agg(F.sum("docs")).first()[0] or 0
    asked = limits.select("context_limit").distinct()
    both = bars.select(F.col("n_tokens").alias("_at"), F.struct("n_tokens", "tokens_at_most", "docs_longer").alias("_bar"), F.lit(None).cast("bigint").alias("context_limit"))
    both = both.unionByName(asked.select(F.col("context_limit").cast("bigint").alias("_at"), F.lit(None).cast(both.schema["_bar"].dataType).alias("_bar"), F.col("context_limit").cast("bigint").alias("context_limit")))
    # Blocks of lengths: the last bar of each earlier block, then the order inside the block.
    both = both.withColumn("_block", F.floor(F.col("_at") / BLOCK))
    lasts = both.groupBy("_block").agg(F.max("_bar").alias("_last"))
    lasts = lasts.select("_block", F.last("_last", ignorenulls=True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("_at", F.col("context_limit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(lasts, "_block").withColumn("_found", F.coalesce(F.last("_bar", ignorenulls=True).over(inside), F.col("_before")))
    longer = F.coalesce(F.col("_found.docs_longer"), F.lit(docs))
    return found.filter("context_limit IS NOT NULL").select(
        "context_limit",
        longer.alias("docs_longer"),
        (F.coalesce(F.col("_found.tokens_at_most"), F.lit(0)) + F.col("context_limit") * longer).alias("truncated_tokens"),
    )
