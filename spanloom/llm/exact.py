"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Distinct blocks are sorted, and a block's integer name is
its rank in that order; then adjacent names are paired and the distinct pairs are sorted and named
in the same way, until each document has one name. Two documents with equally many blocks have the
same name exactly when their texts are equal: no name rests on a hash value.

At scale: the text is shuffled once. Names are ranks inside one of many hash buckets (rank x
buckets + bucket), so no sort is global and a recomputed task gives the same names. The hottest
values, which would fill a bucket, are first reduced to their distinct values (combined before the
shuffle) and named apart. Later levels move integers only; there are log2(blocks) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Tables, hottest, partitions, settled

BLOCK_CHARS = 8192
# A run of white space that is not a single space already.
UNEVEN_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def named(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Add the integer `name`: equal for rows that agree in `columns` (null agrees with null),
    different for all others. Ranks of sorted distinct values, by hash bucket. `df` is a settled table
    with the hash of `columns` in `_hash`: the hottest hashes are found without reading the rest."""
    buckets = 4 * partitions(df.sparkSession)
    hot = hottest(df, "_hash")
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*columns))
    cold = df.filter(~F.col("_hash").isin(hot)) if hot else df
    cold = cold.withColumn("_bucket", F.pmod("_hash", F.lit(buckets))).withColumn(name, (rank.cast("bigint") - 1) * buckets + F.col("_bucket"))
    cold = cold.drop("_hash", "_bucket")
    if not hot:
        return cold
    warm = df.filter(F.col("_hash").isin(hot)).drop("_hash")
    # As many rows as there are hot hash values: the sort and the broadcast are bounded.
    values = warm.select(*columns).distinct().withColumn(name, -F.row_number().over(Window.orderBy(*columns)).cast("bigint"))
    values = values.select(*[F.col(c).alias(f"_v_{c}") for c in columns], name)
    same = [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in columns]
    warm = warm.join(F.broadcast(values), on=same, how="left").drop(*[f"_v_{c}" for c in columns])
    return cold.unionByName(warm)


def document_names(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text_sha256, _row, n_blocks, name: the identity of each row's normalised text is
    (n_blocks, name)."""
    tables = Tables(docs.sparkSession)
    text = docs.select("doc_id", one_space(F.col("text")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    cut = F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{block_chars}}}"), F.lit(0))
    text = text.select("doc_id", "_row", F.sha2("_text", 256).alias("_sha"), F.when(F.length("_text") > block_chars, cut).otherwise(F.array("_text")).alias("_cut"))
    blocks = text.select("doc_id", "_row", "_sha", F.size("_cut").alias("n_blocks"), F.posexplode("_cut").alias("_pos", "_block"))
    first = F.col("_pos") == 0
    blocks = blocks.withColumns({"doc_id": F.when(first, F.col("doc_id")), "_sha": F.when(first, F.col("_sha")), "_hash": F.xxhash64("_block")})
    # Read, cut and hashed once; what follows reads this table.
    level = settled(named(tables.settle(blocks, "blocks"), ["_block"], "name").drop("_block"), "block-names")
    tables.drop("blocks")

    heads = level.filter(F.col("_pos") == 0).select("doc_id", F.col("_sha").alias("text_sha256"), "_row", "n_blocks", "name")
    single, longer = heads.filter("n_blocks = 1"), heads.filter("n_blocks > 1").drop("name")
    width = level.agg(F.max("n_blocks")).first()[0] or 1
    level = level.filter("n_blocks > 1").select("_row", "n_blocks", "_pos", "name")
    results = [single]
    step = 1
    while step < width:
        step *= 2
        half = F.pmod("_pos", F.lit(2))
        pairs = level.groupBy("_row", "n_blocks", F.floor(F.col("_pos") / 2).cast("int").alias("_pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("_left"), F.max(F.when(half == 1, F.col("name"))).alias("_right")
        )
        pairs = tables.settle(pairs.withColumn("_hash", F.xxhash64("_left", "_right")), "pairs")
        level = settled(named(pairs, ["_left", "_right"], "name").drop("_left", "_right"), "pair-names")
        tables.drop("pairs")
        done = level.filter((F.col("n_blocks") > step // 2) & (F.col("n_blocks") <= step))
        results.append(longer.join(done.select("_row", "name"), "_row").select(*single.columns))
        level = level.filter(F.col("n_blocks") > step)
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty; texts are compared after each run of ASCII white space became one space.
    In a group of equal texts the smallest doc_id stays; a null doc_id counts as larger than any
    other, and of rows that repeat one doc_id a single row stays. An empty table gives no rows.
    Other columns of `docs` are ignored.
    """
    names = settled(document_names(docs, block_chars), "document-names")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    # Settled, so that both sides of the join are plain shuffles and a hot group can be split.
    groups = settled(names.groupBy("n_blocks", "name").agg(least.alias("_least"), F.count(F.lit(1)).alias("group_size")), "equal-texts")
    return names.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("_least.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_least.row")).alias("kept"),
        "text_sha256",
    )
