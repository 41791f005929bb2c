"""Ordered scans (running max, running sum, fill, lag, lead) that never put a key in one task.

A plain window partitioned by the key sends every row of a hot key to one task. Here the rows of
a key are split into buckets along the ordering column. Each bucket is reduced to one summary row
by a group-by, which Spark combines on the map side; a window over those few summary rows gives
every bucket what came before or after it; and a window inside (key, bucket) does the rest. The
wide rows are shuffled once, by (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import BUCKET_S

KINDS = ("max_before", "sum_before", "last_before", "first_after", "lag", "lead")


@dataclass(frozen=True)
class Scan:
    """One output column.

    max_before / sum_before: over the rows strictly before (NULL / 0 when there are none).
    last_before / first_after: nearest non-NULL value strictly before / after.
    lag / lead: the value of the neighbouring row, NULL included.
    """

    name: str
    kind: str
    value: Column

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown scan {self.kind!r}")


def time_bucket(column: Column | str, width: float = BUCKET_S) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(float(width))).cast("bigint")


def bucketed_scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    scans: Sequence[Scan],
    keep_bucket: bool = False,
) -> DataFrame:
    """Add one column per scan. `order` names columns, ascending, and must be total up to rows
    that are interchangeable; `bucket` must not decrease along it. With keep_bucket the result keeps the
    bucket as `__b`, by which it is partitioned."""
    keys, order = list(keys), list(order)
    values = {f"__v{i}": scan.value for i, scan in enumerate(scans)}
    base = df.withColumns({"__b": bucket, **values})

    summaries, carried = [], []
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    for i, scan in enumerate(scans):
        value, name = F.col(f"__v{i}"), f"__s{i}"
        row = F.struct(*[F.col(o).alias(f"o{n}") for n, o in enumerate(order)], value.alias("v"))
        summary = F.col(name)
        if scan.kind == "max_before":
            summaries.append(F.max(value).alias(name))
            carried.append(F.max(summary).over(earlier).alias(f"__c{i}"))
        elif scan.kind == "sum_before":
            summaries.append(F.sum(value).alias(name))
            carried.append(F.sum(summary).over(earlier).alias(f"__c{i}"))
        elif scan.kind == "last_before":
            summaries.append(F.max(F.when(value.isNotNull(), row)).alias(name))
            carried.append(F.last(summary, ignorenulls=True).over(earlier)["v"].alias(f"__c{i}"))
        elif scan.kind == "first_after":
            summaries.append(F.min(F.when(value.isNotNull(), row)).alias(name))
            carried.append(F.last(summary, ignorenulls=True).over(later)["v"].alias(f"__c{i}"))
        elif scan.kind == "lag":
            summaries.append(F.max(row).alias(name))
            carried.append(F.lag(summary).over(by_bucket)["v"].alias(f"__c{i}"))
        else:
            summaries.append(F.min(row).alias(name))
            carried.append(F.lead(summary).over(by_bucket)["v"].alias(f"__c{i}"))

    carry = base.groupBy(*keys, "__b").agg(*summaries).select(*keys, "__b", *carried)
    joined = base.join(carry, [*keys, "__b"])

    within = Window.partitionBy(*keys, "__b").orderBy(*[F.col(o).asc() for o in order])
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    # A frame that runs to the end of the partition is recomputed per row; the reversed order
    # turns it into a running frame.
    after = (
        Window.partitionBy(*keys, "__b")
        .orderBy(*[F.col(o).desc() for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    outputs = {}
    for i, scan in enumerate(scans):
        value, carry_value = F.col(f"__v{i}"), F.col(f"__c{i}")
        if scan.kind == "max_before":
            out = F.greatest(carry_value, F.max(value).over(before))
        elif scan.kind == "sum_before":
            out = F.coalesce(carry_value, F.lit(0)) + F.coalesce(F.sum(value).over(before), F.lit(0))
        elif scan.kind == "last_before":
            out = F.coalesce(F.last(value, ignorenulls=True).over(before), carry_value)
        elif scan.kind == "first_after":
            out = F.coalesce(F.last(value, ignorenulls=True).over(after), carry_value)
        elif scan.kind == "lag":
            out = F.when(F.lag(F.lit(True)).over(within), F.lag(value).over(within)).otherwise(carry_value)
        else:
            out = F.when(F.lead(F.lit(True)).over(within), F.lead(value).over(within)).otherwise(carry_value)
        outputs[scan.name] = out
    temporary = [*values, *[f"__c{i}" for i in range(len(scans))]] + ([] if keep_bucket else ["__b"])
    return joined.withColumns(outputs).drop(*temporary)


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row within its key."""
    return bucketed_scan(df, keys, bucket, order, [Scan(name, "sum_before", F.lit(1))])


def as_of(
    probes: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    row_time: str,
    payload: Column,
    name: str,
    width: float = BUCKET_S,
    tie: Column | None = None,
) -> DataFrame:
    """Backward as-of join: `probes` with the payload of the last row at or before each probe
    (NULL before the first). Among rows of one time the largest `tie` wins."""
    tie = F.lit(0) if tie is None else tie
    right = rows.select(*keys, F.col(row_time).alias("__t"), F.lit(0).alias("__side"), tie.alias("__tie"), payload.alias("__p"))
    probe_row = F.struct(*[F.col(c) for c in probes.columns])
    left = probes.select(*keys, F.col(probe_time).alias("__t"), F.lit(1).alias("__side"), probe_row.alias("__row"))
    both = right.unionByName(left, allowMissingColumns=True)
    scanned = bucketed_scan(
        both, keys, time_bucket("__t", width), ["__t", "__side", "__tie"], [Scan("__hit", "last_before", F.col("__p"))]
    )
    return scanned.where(F.col("__side") == 1).select("__row.*", F.col("__hit").alias(name))
