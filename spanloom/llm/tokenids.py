"""Token ids on disk as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id, level
k the k-th chunk of the ids that have one; a bitmap per level says which ids go on, and a directory
holds the number of set bits before every 512th position. Any token is read alone: its place in the
next level is the rank of its bit, so no block is decoded and no offset is stored per token.

The file format is a Parquet table of segments, written by Spark's own writer and so complete or
absent after a lost executor. A segment holds whole documents in ascending order of doc_id, about
`SEGMENT_IDS` ids: part (place of the range of doc_ids), segment (place in the part), n_ids, doc_ids,
doc_tokens and levels (chunks, more, ranks). The parts are ranges of doc_id, so (part, segment) is
the order of the ids.
"""

from __future__ import annotations

import gc
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import batch_of, partitions, pieces, ready, strings

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_IDS = 1 << 18
KNOWN_WORDS = 600_000
ASKED = 1 << 14  # words that the library is asked for at a time: its answers are large
SLICE = 4 << 20
# A space between two characters that are no white space always begins a token of its own word.
CUT = re.compile(r"(?<=\S) (?=\S)")
# White space of a text without any of these, and without white space at its ends, is single spaces and line ends.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
UNEVEN = ["  ", " \n", "\n ", "\n\n", *SPACES]
PUNCTUATION = string.punctuation

LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema(
    [("part", pa.int32()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))]
)
SEGMENT_COLUMNS = "part int, segment bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, levels array<struct<chunks: binary, more: binary, ranks: binary>>"


# ---- codes -----------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS > 0
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(per_block)[:-1])) if len(per_block) else per_block
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK_BITS


def unpack(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.frombuffer(levels[0]["chunks"], dtype=np.uint8).astype(np.uint32)
    places = np.arange(len(ids))
    for number, level in enumerate(levels[1:], 1):
        bits = np.unpackbits(np.frombuffer(levels[number - 1]["more"], dtype=np.uint8), count=len(places), bitorder="little")
        places = places[bits.astype(bool)]
        ids[places] |= np.frombuffer(level["chunks"], dtype=np.uint8).astype(np.uint32) << np.uint32(CHUNK_BITS * number)
    return ids


def token_at(levels: list[dict[str, bytes]], place: int) -> int:
    """One id, from one chunk, one bit and one directory entry per level."""
    value = 0
    for number, level in enumerate(levels):
        value |= level["chunks"][place] << (CHUNK_BITS * number)
        bits = level["more"]
        if not bits[place >> 3] >> (place & 7) & 1:
            break
        block = place // RANK_BITS
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        low = int.from_bytes(bits[block * RANK_BITS // 8 : place // 8 + 1], "little")
        rank += (low & ((1 << (place - block * RANK_BITS)) - 1)).bit_count()
        place = rank
    return value


# ---- encoding --------------------------------------------------------------------------------


class WordEncoder:
    """A byte-level BPE of the tokenizers library, asked once per word. A text whose white space is single
    spaces and line ends, each between two other characters, is cut at all of them: a line end is a word
    of its own there, and what follows it begins without a space. Other texts are cut before spaces
    between two characters that are no white space, where a new word begins in any case. A word of
    letters and the ASCII punctuation behind it are words of their own to the tokenizer, so they are
    asked for one by one. A text that holds an added token of the tokenizer goes to it whole."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(content)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        # A run of letters is not cut further: no search for the words in it. One library serves both ways.
        self.usual, self.whole = self.library.pre_tokenizer, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.line = self._all(["\n"])[0]
        self.stems: dict[str, bytes] = {}  # with the space before them, if there is one
        self.known: dict[str, bytes] = {}  # words that are not letters and punctuation
        self.tails: dict[str, bytes] = {}

    def _all(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), ASKED):
            out += [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(words[i : i + ASKED], add_special_tokens=False)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        self.library.pre_tokenizer = self.whole
        try:
            return self._all(words)
        finally:
            self.library.pre_tokenizer = self.usual

    def forget(self) -> None:
        for known in (self.stems, self.known, self.tails):
            known.clear()

    def even(self, text: str) -> bool:
        if text[:1].isspace() or text[-1:].isspace() or any(rare in text for rare in UNEVEN):
            return False
        return not any(token in text for token in self.added)

    def cut(self, text: str) -> list[str]:
        return [text] if any(token in text for token in self.added) else CUT.split(text)

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, a space before them where the text has one."""
        stems = [word.rstrip(PUNCTUATION) for word in words]
        ends = [word[len(stem) :] for word, stem in zip(words, stems)]
        if len(self.stems) + len(self.known) + len(words) > KNOWN_WORDS:
            self.forget()
        new = set(stems) - self.stems.keys()
        letters = [stem for stem in new if stem.removeprefix(" ").isalpha()]
        new.difference_update(letters)
        others = [word for word, stem in zip(words, stems) if stem in new and word not in self.known]
        self.stems.update(zip(letters, self._letters(letters)))
        self.known.update(zip(others, self._all(others)))
        tails = list(set(ends) - self.tails.keys())
        self.tails.update(zip(tails, self._all(tails)))
        found, tails = map(self.stems.get, stems), self.tails
        return [self.known[word] if ids is None else ids + tails[end] if end else ids for word, end, ids in zip(words, ends, found)]

    def _even(self, texts: list[str], end: np.ndarray) -> list[np.ndarray]:
        rows = pa.array([("\n" + text).replace("\n", " \n")[1:] for text in texts], type=pa.large_string())
        lists = pc.split_pattern(rows, " ")
        words = lists.flatten().dictionary_encode()
        distinct, place = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        heads = [word[0] == "\n" for word in distinct]
        found = self._ids([word[1:] if head else " " + word for word, head in zip(distinct, heads)])
        found = [self.line + ids if head else ids for ids, head in zip(found, heads)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        starts, counts = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(starts[place] - ends + counts, counts) + np.arange(ends[-1])]
        # The line end before a text is not its own.
        last = ends[lists.offsets.to_numpy()[1:] - 1].tolist()
        skip = len(self.line) >> 2
        return [np.concatenate([ids[a + skip : b], end]) for a, b in zip([0, *last], last)]

    def _uneven(self, texts: list[str], end: np.ndarray) -> list[np.ndarray]:
        cut = [self.cut(text) for text in texts]
        heads = self._all([words[0] for words in cut])
        words = list(set().union(*(words[1:] for words in cut)))
        find = dict(zip(words, self._ids([" " + word for word in words]))).__getitem__
        return [np.frombuffer(b"".join([head, *map(find, words[1:]), end.tobytes()]), dtype="<u4") for head, words in zip(heads, cut)]

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        end = np.array([end_id], dtype="<u4")
        even = [self.even(text) for text in texts]
        sides = {}
        for kind, method in ((True, self._even), (False, self._uneven)):
            mine = [text for text, e in zip(texts, even) if e is kind]
            sides[kind] = iter(method(mine, end) if mine else [])
        return [next(sides[e]) for e in even]


def _segments(content: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # A task has one core: threads of the library's own double the CPU time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # nothing here makes cycles, and going through the tables of words takes long
        encoder = WordEncoder(content)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, found, size = [], [], 0

        def segment():
            ids = np.concatenate(found)
            row = {"part": part, "segment": number, "n_ids": len(ids), "doc_ids": doc_ids, "doc_tokens": [len(f) for f in found], "levels": pack(ids)}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT)

        try:
            for batch in pieces(batches, "text", SLICE):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(strings(batch, "text"), end_id)):
                    if found and size + len(ids) > limit:
                        yield segment()
                        doc_ids, found, size, number = [], [], 0, number + 1
                    doc_ids.append(doc_id)
                    found.append(ids)
                    size += len(ids)
            if found:
                yield segment()
        finally:
            # The worker goes on to other tasks; what a task leaves in cycles must not stay in it.
            encoder.forget()
            gc.enable()

    return run


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of `docs` (doc_id, text) in ascending order of doc_id, `end_id` after each
    document. Null texts are empty; a null doc_id comes first; rows of one doc_id follow each other in the
    order of their texts' hashes, spread over parts if they are many. Special tokens are not added;
    one that a text spells out has its own id, as the library gives it. An empty table gives a table
    without segments."""
    ready(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    # Half as many parts as a shuffle has: the more text a part has, the fewer words are asked for twice.
    parts = max(1, partitions(docs.sparkSession) // 2)
    ordered = ordered.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    rows = ordered.select("doc_id", "text").mapInArrow(_segments(content, end_id, segment_ids), SEGMENT_COLUMNS)
    # The levels are dense already; heavier compression would cost more than it saves.
    rows.write.option("compression", "zstd").parquet(path)


# ---- reading ---------------------------------------------------------------------------------


def _directory(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, n_ids, start (ids before the segment)."""
    rows = spark.read.schema(SEGMENT_COLUMNS).parquet(path).select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("_ids"))  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return rows.join(parts, "part").select("part", "segment", "n_ids", (F.col("_before") + F.col("_inside")).alias("start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("_local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = unpack(row["levels"]).astype("<u4")
            ends = np.cumsum(row["doc_tokens"])
            starts = ends - row["doc_tokens"]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield batch_of(schema, [row["part"]] * n, [row["segment"]] * n, row["doc_ids"], starts, row["doc_tokens"], sums)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in a table of token ids."""
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a segment
    rows = spark.read.schema(SEGMENT_COLUMNS).parquet(path).select("part", "segment", "doc_ids", "doc_tokens", "levels")
    docs = rows.mapInArrow(_documents, "part int, segment bigint, doc_id bigint, _local bigint, n_tokens bigint, ids_crc32 bigint")
    docs = docs.join(_directory(spark, path), ["part", "segment"])
    return docs.select("doc_id", (F.col("start") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32")


def _at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("position", pa.int64()), ("token_id", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            yield batch_of(schema, [p + row["start"] for p in row["_places"]], [token_at(row["levels"], p) for p in row["_places"]])


def read_tokens(spark: SparkSession, path: str, positions: DataFrame, block: int = SEGMENT_IDS) -> DataFrame:
    """position, token_id for the rows of `positions` (position, counted over the whole table of
    token ids); positions outside it give no row. Positions meet the directory by blocks of the
    position; only segments that are asked for are joined, and in them only the tokens asked for are read."""
    ready(spark)
    directory = _directory(spark, path).filter("n_ids > 0")
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_ids") - 1) / block)))
    asked = positions.select("position", F.floor(F.col("position") / block).alias("_block")).distinct()
    found = asked.join(directory.withColumn("_block", blocks), "_block").filter("position >= start AND position < start + n_ids")
    # A segment is bounded, so are the distinct places in it.
    found = found.groupBy("part", "segment", "start").agg(F.collect_list(F.col("position") - F.col("start")).alias("_places"))
    segments = spark.read.schema(SEGMENT_COLUMNS).parquet(path).select("part", "segment", "levels")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return found.join(segments, ["part", "segment"]).select("start", "_places", "levels").mapInArrow(_at, "position bigint, token_id bigint")
