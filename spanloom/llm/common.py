"""What the operators share: settled tables, slices of Arrow batches, names of parameters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import scratch

# Rows that an Arrow batch carries to a Python task; batches are cut further by bytes (`pieces`).
BATCH_ROWS = "512"
# Text that a Python task works on at a time.
SLICE_BYTES = 4 << 20
# The hottest values of a key that are handled apart. A value with more than 1/HOT of the rows is
# among them, whatever the data.
HOT = 256
# Settled tables hold texts, which this makes a quarter smaller than the usual codec does.
CODEC = "zstd"


def ready(spark: SparkSession, broadcasts: bool = True) -> SparkSession:
    """Settings under which Python tasks stay small; broadcasts are left to the session's own thresholds,
    or made by no size at all, so that a job joins small tables as it does large ones."""
    for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        if broadcasts:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, "-1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the shared checkpoint folder and read back: later steps read
    it instead of computing it again, and a lost executor costs only the tasks after it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Settled tables of one run by name, dropped as soon as the tables made of them are whole."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = scratch(self.spark, name)
        df.write.parquet(path, compression=CODEC)
        # Shuffles of finished jobs go when the driver's JVM finds them unused; it is asked to look.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hottest(df: DataFrame, key: str, least: int = 64) -> list[int]:
    """At most HOT values of the integer column `key`, the most frequent ones, that `least` rows or
    more have. The counts are combined before the shuffle; only this bounded list is collected."""
    counts = df.groupBy(key).count().filter(F.col("count") >= least)
    return [row[key] for row in counts.orderBy(F.desc("count"), key).limit(HOT).collect()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has about `limit` bytes in `column`, or a single row."""
    for batch in batches:
        start, size = 0, 0
        values = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        for i, length in enumerate(lengths):
            if i > start and size + length > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [value or "" for value in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)
