"""Interval algebra per key: union, complement, overlap and containment joins.

Every function takes (keys, start, end) columns in seconds. Joins carry the key and a time bucket
as equality conditions, so a long recording is spread over many tasks; a pair is produced in the
bucket of its later start and in no other, so no de-duplication is needed. Spans longer than a few
buckets are kept at levels of wider buckets, so that their number of copies does not grow with
their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import BUCKET_S, JOIN_BUCKET_S
from spanloom.operators.scans import Scan, bucketed_scan, time_bucket

KEYS = ("item_id",)

# Each level's buckets are this many times as wide as those of the level below. Spans of up to as many
# buckets of level 0 stay there; a longer one lies at the level whose buckets are not shorter than it.
LEVEL_BASE = 8
TOP_LEVEL = 16
# A wide bucket holds many short rows: they are dealt over so many groups, and long rows go to each.
LEVEL_GROUPS = 8


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict overlap: touching intervals do not overlap, a point only when strictly inside."""
    return (a_start < b_end) & (b_start < a_end)


def in_buckets(df: DataFrame, start: str, end: str, width: float = JOIN_BUCKET_S, name: str = "__b") -> DataFrame:
    """One copy of each row per time bucket its interval touches."""
    first, last = time_bucket(start, width), time_bucket(end, width)
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def span_level(start: Column, end: Column, width: float = JOIN_BUCKET_S) -> Column:
    """The level of a span: 0 up to LEVEL_BASE buckets, then the first whose buckets are as long."""
    size = (end - start) / F.lit(float(width))
    level = F.least(F.ceil(F.log(size) / F.log(F.lit(float(LEVEL_BASE)))), F.lit(TOP_LEVEL))
    return F.when(size > LEVEL_BASE, level).otherwise(0).cast("int")


def level_bucket(at: Column, level: Column, width: float = JOIN_BUCKET_S) -> Column:
    return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(float(LEVEL_BASE)), level))).cast("bigint")


def long_levels(df: DataFrame, span: tuple[str, str], width: float) -> Column:
    """The levels above 0 that spans of `df` have, TOP_LEVEL at most, as a scalar subquery."""
    level = span_level(F.col(span[0]), F.col(span[1]), width)
    return df.agg(F.collect_set(F.when(level > 0, level))).scalar()


def in_levels(df: DataFrame, span: tuple[str, str], asked: Column, own: str, width: float) -> DataFrame:
    """Copies of each row by (__k, __b, __g): in the buckets it touches at its own level, and at the
    levels above it that the other side has (`asked`). At its own level, unless that is 0, and at those
    above it a row touches two buckets at most; at its own it goes to every group of them."""
    start, end = F.col(span[0]), F.col(span[1])
    leveled = df.withColumns({own: span_level(start, end, width), "__asked": asked})
    visited = leveled.withColumn("__k", F.explode(F.concat(F.array(own), F.filter("__asked", lambda k: k > F.col(own))))).drop("__asked")
    first, last = level_bucket(start, F.col("__k"), width), level_bucket(end, F.col("__k"), width)
    placed = visited.withColumn("__b", F.explode(F.sequence(first, F.greatest(first, last))))
    every = F.sequence(F.lit(0), F.lit(LEVEL_GROUPS - 1))
    mine = F.array(F.pmod(time_bucket(start, width), F.lit(LEVEL_GROUPS)).cast("int"))
    groups = F.when(F.col("__k") == 0, F.array(F.lit(0))).when(F.col(own) == F.col("__k"), every).otherwise(mine)
    return placed.withColumn("__g", F.explode(groups))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = KEYS,
    left_span: tuple[str, str] = ("start", "end"),
    right_span: tuple[str, str] = ("r_start", "r_end"),
    width: float = JOIN_BUCKET_S,
) -> DataFrame:
    """Pairs of rows whose intervals overlap strictly. Column names of the two sides must differ
    outside the keys. A pair meets at the level of its longer span, whatever the length of either; the
    spans of each side are read once more for the levels that they have, so a side that is dear to
    compute should be settled."""
    (ls, le), (rs, re) = left_span, right_span
    a = in_levels(left, left_span, long_levels(right, right_span, width), "__own", width)
    b = in_levels(right, right_span, long_levels(left, left_span, width), "__r_own", width)
    later = F.greatest(F.col(ls), F.col(rs))
    level = F.greatest("__own", "__r_own") == F.col("__k")
    # Two spans of one level meet in every group.
    once = (F.col("__own") != F.col("__r_own")) | (F.col("__g") == 0)
    met = overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re)) & level & once & (F.col("__b") == level_bucket(later, F.col("__k"), width))
    return a.join(b, [*keys, "__k", "__b", "__g"]).where(met).drop("__k", "__b", "__g", "__own", "__r_own")


def overlapping(
    left: DataFrame,
    right: DataFrame,
    row_id: Sequence[str],
    keys: Sequence[str] = KEYS,
    left_span: tuple[str, str] = ("start", "end"),
    right_span: tuple[str, str] = ("start", "end"),
    keep: bool = True,
    width: float = JOIN_BUCKET_S,
) -> DataFrame:
    """Rows of `left` that overlap some (keep) or no (not keep) row of `right`; `row_id` is
    unique on the left."""
    probe = right.select(*keys, F.col(right_span[0]).alias("__rs"), F.col(right_span[1]).alias("__re"))
    hits = overlap_join(left.select(*keys, *[c for c in row_id if c not in keys], *left_span), probe, keys, left_span, ("__rs", "__re"), width)
    ids = [*keys, *[c for c in row_id if c not in keys]]
    return left.join(hits.select(*ids).distinct(), ids, "left_semi" if keep else "left_anti")


def point_join(
    points: DataFrame,
    spans: DataFrame,
    point: Column,
    span: tuple[str, str],
    keys: Sequence[str] = KEYS,
    how: str = "inner",
    closed: bool = False,
    width: float = JOIN_BUCKET_S,
) -> DataFrame:
    """Points inside spans: [start, end), or [start, end] when closed. A point has one bucket,
    so semi and anti joins are exact as they are."""
    s, e = F.col(span[0]), F.col(span[1])
    left = points.withColumn("__p", point).withColumn("__b", time_bucket("__p", width))
    right = in_buckets(spans, span[0], span[1], width)
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys, "__b", s.alias("__ps"), e.alias("__pe"))
        s, e = F.col("__ps"), F.col("__pe")
    inside = (F.col("__p") >= s) & ((F.col("__p") <= e) if closed else (F.col("__p") < e))
    for key in [*keys, "__b"]:
        inside = inside & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    joined = left.alias("l").join(right.alias("r"), inside, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__p", "__b")
    kept = [F.col(f"l.{c}") for c in points.columns]
    return joined.select(*kept, *[F.col(f"r.{c}") for c in spans.columns if c not in keys])


def _led(df: DataFrame, keys: Sequence[str], start: str, end: str, width: float) -> DataFrame:
    """Spans with `__prev`, the running maximum of the ends before them, and their bucket."""
    spans = df.select(*keys, F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"))
    prev = Scan("__prev", "max_before", F.col("end"))
    return bucketed_scan(spans, keys, time_bucket("start", width), ["start", "end"], [prev], keep_bucket=True)


def union_spans(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    start: str = "start",
    end: str = "end",
    keep_empty: bool = False,
    width: float = BUCKET_S,
) -> DataFrame:
    """Disjoint union per key; touching spans merge; empty spans are dropped unless kept."""
    if not keep_empty:
        df = df.where(F.col(end) > F.col(start))
    led = _led(df, keys, start, end, width)
    leads = F.col("__prev").isNull() | (F.col("start") > F.col("__prev"))
    upto = (
        Window.partitionBy(*keys, "__b").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Spans of one bucket behind the same leader collapse first (no leader: they continue an
    # island of an earlier bucket), so the second scan runs over islands, not over spans.
    parts = (
        led.withColumn("__lead", F.when(leads, F.col("start")))
        .withColumn("__local", F.last("__lead", ignorenulls=True).over(upto))
        .groupBy(*keys, "__b", "__local")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    earlier = Scan("__from", "last_before", F.col("__local"))
    scanned = bucketed_scan(parts, keys, F.col("__b"), ["__b", "start"], [earlier])
    return (
        scanned.withColumn("__island", F.coalesce("__local", "__from"))
        .groupBy(*keys, "__island")
        .agg(F.max("end").alias("end"))
        .select(*keys, F.col("__island").alias("start"), "end")
    )


def union_seconds(
    df: DataFrame, keys: Sequence[str] = KEYS, start: str = "start", end: str = "end", width: float = BUCKET_S
) -> DataFrame:
    """Length of the union per key, as (keys, seconds): each span adds the part of it that lies
    beyond the running maximum of the ends before it."""
    led = _led(df.where(F.col(end) > F.col(start)), keys, start, end, width)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("__prev", "start")), F.lit(0.0))
    return led.groupBy(*keys).agg(F.sum(fresh).alias("seconds"))


def complement(
    df: DataFrame,
    extents: DataFrame,
    keys: Sequence[str] = KEYS,
    start: str = "start",
    end: str = "end",
    width: float = BUCKET_S,
) -> DataFrame:
    """Maximal stretches of each key's extent (keys, lo, hi) that no span covers; a key without
    spans gives its whole extent, an empty extent nothing."""
    extents = extents.where(F.col("hi") > F.col("lo"))
    spans = df.where(F.col(end) > F.col(start)).select(
        *keys, F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end")
    )
    # An opening row brings the extent into the scan (no join of the spans with the extents), a
    # closing row makes the trailing gap a gap before a row like any other.
    bounds = F.struct(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    opening = extents.select(*keys, F.col("lo").cast("double").alias("start"), F.col("lo").cast("double").alias("end"), bounds.alias("bounds"))
    closing = extents.select(*keys, F.col("hi").cast("double").alias("start"), F.col("hi").cast("double").alias("end"))
    rows = opening.unionByName(closing, allowMissingColumns=True).unionByName(spans, allowMissingColumns=True)
    led = bucketed_scan(
        rows,
        keys,
        time_bucket("start", width),
        ["start", "end"],
        [Scan("__prev", "max_before", F.col("end")), Scan("__bounds", "last_before", F.col("bounds"))],
    )
    # Rows before the opening one have no bounds and give no gap.
    return (
        led.where(F.col("start") > F.col("__prev"))
        .select(
            *keys,
            F.greatest("__prev", "__bounds.lo").alias("start"),
            F.least("start", "__bounds.hi").alias("end"),
            F.col("__bounds").isNotNull().alias("__in"),
        )
        .where(F.col("__in") & (F.col("end") > F.col("start")))
        .drop("__in")
    )


def hypothesis_gaps(ref: DataFrame, hyp: DataFrame, min_gap: float = 2.0) -> DataFrame:
    """Stretches without hypothesis words inside the joint extent of both sides."""
    if min_gap < 0:
        raise ValueError("min_gap must be non-negative")
    both = ref.select("item_id", "start", "end").unionByName(hyp.select("item_id", "start", "end"))
    extents = both.groupBy("item_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    return complement(hyp, extents).where(F.col("end") - F.col("start") >= min_gap)


def words_in_gaps(ref: DataFrame, hyp: DataFrame, min_gap: float = 2.0) -> DataFrame:
    """Per item, the reference words whose middle lies in a hypothesis gap, edges included."""
    gaps = hypothesis_gaps(ref, hyp, min_gap)
    middle = (F.col("start") + F.col("end")) / 2.0
    return point_join(ref, gaps, middle, ("start", "end"), how="left_semi", closed=True).groupBy("item_id").agg(F.count("*").alias("words"))
