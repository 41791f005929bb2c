"""Numeric series: (item_id, idx, value) rows, one per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BUCKET = 160000


def level_dbfs(samples: DataFrame, windows: DataFrame, rate: int, floor: float = -120.0) -> DataFrame:
    """`windows` with `level`: RMS in dB of the samples in [round(start * rate), round(end * rate)),
    the floor where there is none."""
    ranged = windows.select(
        "item_id", "start", "end",
        F.greatest(F.bround(F.col("start") * rate).cast("bigint"), F.lit(0)).alias("lo"),
        F.bround(F.col("end") * rate).cast("bigint").alias("hi"),
    )
    # Ten seconds a bucket at any rate: a window is compared with the samples of its own few seconds.
    width = F.lit(min(SAMPLE_BUCKET, max(1, 10 * int(rate))))
    by_bucket = ranged.where(F.col("hi") > F.col("lo")).withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    )
    energy = (
        samples.withColumn("__b", F.floor(F.col("idx") / width))
        .join(by_bucket, ["item_id", "__b"])
        .where((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
        .groupBy("item_id", "start", "end")
        .agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    )
    level = F.when(F.col("rms") > 0, F.greatest(F.lit(floor), 20.0 * F.log10("rms"))).otherwise(F.lit(floor))
    return windows.join(energy, ["item_id", "start", "end"], "left").withColumn("level", level).drop("rms")


def overview_peaks(samples: DataFrame, items: DataFrame, bins: int = 1200, scale: int = 100) -> DataFrame:
    """(item_id, bin, peak): largest magnitude per equal bin, the loudest bin reading `scale`."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    sizes = samples.groupBy("item_id").agg((F.max("idx") + 1).alias("n"), F.max(F.abs(F.col("value").cast("float"))).alias("top"))
    step = F.col("n").cast("double") / bins
    guess = F.ceil((F.col("idx") + 1).cast("double") * bins / F.col("n")).cast("bigint")
    # The edges are truncated products, so the guess is settled against its neighbours.
    near = F.filter(
        F.transform(F.array(*[F.lit(d) for d in (-2, -1, 0, 1)]), lambda d: F.least(guess + d, F.lit(bins - 1).cast("bigint"))),
        lambda k: (k >= 0) & (F.floor(k * step) <= F.col("idx")),
    )
    peaks = (
        samples.join(sizes.select("item_id", "n"), "item_id")
        .withColumn("bin", F.array_max(near))
        .groupBy("item_id", "bin")
        .agg(F.max(F.abs(F.col("value").cast("float"))).alias("v"))
    )
    grid = items.select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    full = grid.join(peaks, ["item_id", "bin"], "left").join(sizes.select("item_id", "top"), "item_id", "left")
    scaled = F.bround(((F.lit(float(scale)).cast("float") * F.col("v")).cast("float") / F.col("top")).cast("float").cast("double"))
    return full.select("item_id", "bin", F.when((F.col("top") > 0) & F.col("v").isNotNull(), scaled).otherwise(F.lit(0.0)).cast("int").alias("peak"))


def mix_channels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two 16-bit series summed so that both end together, clipped to the 16-bit range."""
    a, b = (df.groupBy("item_id").agg((F.max("idx") + 1).alias(n)) for df, n in ((first, "na"), (second, "nb")))
    sizes = a.join(b, "item_id", "full_outer").select(
        "item_id", *[(F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))) - F.coalesce(n, F.lit(0))).alias(s) for n, s in (("na", "sa"), ("nb", "sb"))]
    )
    moved = [df.join(sizes, "item_id").select("item_id", (F.col("idx") + F.col(s)).alias("idx"), F.col("value").cast("int").alias("value")) for df, s in ((first, "sa"), (second, "sb"))]
    summed = moved[0].unionByName(moved[1]).groupBy("item_id", "idx").agg(F.sum("value").alias("value"))
    return summed.withColumn("value", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.col("value"))))


def cut_window(samples: DataFrame, rate: int, start: float, end: float) -> DataFrame:
    """Samples inside [start, end) seconds, counted from the cut."""
    if end <= start or start < 0:
        raise ValueError("the window must be increasing and non-negative")
    lo, hi = round(start * rate), round(end * rate)
    return samples.where((F.col("idx") >= lo) & (F.col("idx") < hi)).withColumn("idx", F.col("idx") - lo)
