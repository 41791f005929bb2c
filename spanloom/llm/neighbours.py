"""The next row of each row in an order over the whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import partitions

CELLS = 1024


def buckets_of(df: DataFrame, key: str, wanted: int) -> tuple[int, int, list[int], list[int | None]]:
    """Lowest key, cell width, bucket of each cell, largest key of each bucket. The range of the
    integer `key` is cut into CELLS cells; neighbouring cells are put together until each
    bucket has about 1/wanted of the rows. Only CELLS counts are collected."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return 0, 1, [0] * CELLS, [None]
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = _cell(key, low, width)
    rows = {r["_cell"]: r for r in df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top")).collect()}
    share = max(1, sum(r["n"] for r in rows.values()) // wanted)
    bucket, held, of_cell, tops = 0, 0, [], [None]
    for i in range(CELLS):
        if held >= share and i in rows:
            bucket, held = bucket + 1, 0
            tops.append(None)
        of_cell.append(bucket)
        if i in rows:
            held += rows[i]["n"]
            tops[bucket] = rows[i]["top"] if rows[i]["top"] is not None else tops[bucket]
    return low, width, of_cell, tops


def _cell(key: str, low: int, width: int):
    return F.coalesce(F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int"), F.lit(0))


def with_next(df: DataFrame, key: str, columns: list[str], ties: list[str]) -> DataFrame:
    """Add `_next_<column>` for each of `columns`: the value in the next row by falling `key` (null
    last; equal keys by `ties`), after the last row the first. Rows are shuffled once, by `_bucket`,
    by which the result is partitioned; the first row of each bucket also travels to the bucket
    before it."""
    low, width, of_cell, tops = buckets_of(df, key, 2 * partitions(df.sparkSession))
    n = len(tops)
    df = df.withColumn("_bucket", F.element_at(F.lit(of_cell), _cell(key, low, width) + 1))
    # A bucket's largest key is its first row in the falling order.
    is_first = F.col(key).eqNullSafe(F.element_at(F.lit(tops).cast("array<bigint>"), F.col("_bucket") + 1))
    home = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    away = F.struct(F.pmod(F.col("_bucket") + 1, F.lit(n)).alias("bucket"), F.lit(1).alias("guest"))
    df = df.withColumn("_place", F.explode(F.when(is_first, F.array(home, away)).otherwise(F.array(home))))
    df = df.withColumns({"_bucket": F.col("_place.bucket"), "_guest": F.col("_place.guest")}).drop("_place")
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last(key), *ties)
    df = df.withColumns({f"_next_{c}": F.lead(c).over(order) for c in columns})
    return df.filter("_guest = 0").drop("_guest")
