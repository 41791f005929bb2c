"""One text file per item, published as a whole or not at all.

A write puts its files under <path>/_staging, a folder for each attempt of a task. When all tasks are
done the driver moves the folders of the attempts that counted together (one rename a task) and
publishes them by one rename, as <path>/v<number>. Attempts that were lost or ran twice stay behind in
the staging folder, which the end of the job removes. A reader takes the newest version: the last one
that was complete. The version before it is kept for readers that have begun, older ones go.
Rename must be atomic for folders, as it is on HDFS and on local and network file systems.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from spanloom.sources.stores import located

# Files a folder holds at most.
FOLDER_FILES = 1024
_VERSION = re.compile(r"^v(\d{8})$")


def versions(path: str) -> list[str]:
    """Names of the published versions, oldest first."""
    system, base = located(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and _VERSION.match(f.base_name))


@dataclass
class Written(WriterCommitMessage):
    task: int
    folder: str
    files: int


class ItemFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, extension: str) -> None:
        self.path, self.extension, self.run = path, extension, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (item_id, value) come with an item's rows in a stretch; each is a line of its file."""
        system, base = located(self.path)
        task = TaskContext.get().partitionId()
        folder = f"{base}/_staging/{self.run}/{task:08d}-{uuid.uuid4().hex}"
        item, stream, files = None, None, 0
        try:
            for batch in iterator:
                for name, value in zip(batch.column("item_id").to_pylist(), batch.column("value").to_pylist()):
                    if name is None:
                        raise ValueError("a row without an item has no file to go to")
                    if stream is None or name != item:
                        if stream is not None:
                            stream.close()
                        inner = f"{folder}/{files // FOLDER_FILES:06d}"
                        if files % FOLDER_FILES == 0:
                            system.create_dir(inner, recursive=True)
                        stream = system.open_output_stream(f"{inner}/{_file_name(name, self.extension)}", compression=None, buffer_size=1 << 16)
                        item, files = name, files + 1
                    stream.write(((value or "") + "\n").encode())
        finally:
            if stream is not None:
                stream.close()
        return Written(task, folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = located(self.path)
        ready = f"{base}/_staging/{self.run}/ready"
        system.create_dir(ready, recursive=True)
        for message in messages:
            if message is not None and message.files:
                system.move(message.folder, f"{ready}/{message.task:08d}")
        before = versions(self.path)
        number = int(_VERSION.match(before[-1])[1]) + 1 if before else 1
        system.move(ready, f"{base}/v{number:08d}")
        for old in before[:-1]:
            system.delete_dir(f"{base}/{old}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = located(self.path)
        staged = f"{base}/_staging/{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


def _file_name(item: str, extension: str) -> str:
    # "." is not quoted, and a leading "." or "_" would hide the file from Spark.
    name = quote(item, safe=" ")
    name = f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in (".", "_") else name
    return f"{name}.{extension}"


class ItemFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "item_files"

    def schema(self) -> str:
        return "item_id string, value string"

    def writer(self, schema, overwrite: bool) -> ItemFilesWriter:
        if not overwrite:
            raise ValueError("a write is a version of its own: use mode overwrite")
        return ItemFilesWriter(self.options["path"], self.options.get("extension", "txt"))


def write_items(rows: DataFrame, path: str, order: Iterable[str | Column], extension: str = "txt") -> None:
    """`rows` (item_id, value, order columns) as a text file per item, a line per row. Rows are ranged
    by item and order: an item of many rows is a file in each of several tasks' folders, in their
    order. Null values are empty lines; a null item is an error, and an empty table is an empty version."""
    order = list(order)
    rows.sparkSession.dataSource.register(ItemFiles)
    placed = rows.repartitionByRange("item_id", *order).sortWithinPartitions("item_id", *order)
    placed = placed.select(F.col("item_id").cast("string").alias("item_id"), F.col("value").cast("string").alias("value"))
    placed.write.format("item_files").mode("overwrite").option("path", path).option("extension", extension).save()


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id string, part, value) of the newest version: a row per file, whose parts follow one
    another; no rows before the first version."""
    names = versions(path)
    if not names:
        return spark.createDataFrame([], "item_id string, part int, value string")
    files = spark.read.option("recursiveFileLookup", True).text(f"{path}/{names[-1]}", wholetext=True)
    # The reader's path is a URI in which our own "%" is encoded once more.
    steps = F.split(F.col("_metadata.file_path"), "/")
    name = F.url_decode(F.replace(F.element_at(steps, -1), F.lit("+"), F.lit("%2B")))
    item = F.url_decode(F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("+"), F.lit("%2B")))
    return files.select(item.alias("item_id"), F.element_at(steps, -3).cast("int").alias("part"), "value")
