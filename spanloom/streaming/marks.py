"""Marks of the two-source review as words arrive, from state kept per recording.

A recording's words are map state in blocks of positions, so a batch reads and writes the blocks it
touches and nothing of earlier batches. Silent stretches of the publisher that wait for words after
them are map state, too; what has been heard of each source is a small map, the recording itself a
value. A mark leaves once no further word in order can change it, and a closed recording leaves
with all its state but the note that it is closed; with event times a timer takes that away, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.config import ReviewSettings
from spanloom.functions.text import normalized

BLOCK = 256
CLOSED_MS = 24 * 3600 * 1000  # of event time, that a closed recording is remembered
TOLERANCE = 1e-9
SOURCES = ("publisher", "detector")
COLUMNS = "kind string, item_id {key}, start double, end double, span_start double, span_end double, detector_words bigint, detector_text string, source string, seq bigint, text string"
Word = tuple[float, float, int, str, str]  # start, end, seq, shown, normal form


class _Words:
    """Words of one source in the order of their starts, behind map state of blocks."""

    def __init__(self, state, source: str, heard: tuple | None) -> None:
        self.state, self.source = state, source
        self.n, self.seen, self.longest = heard or (0, None, 0.0)
        self.blocks: dict[int, list[Word]] = {}
        self.changed: set[int] = set()

    def block(self, number: int) -> list[Word]:
        if number not in self.blocks:
            key = (self.source, number)
            self.blocks[number] = list(zip(*self.state.getValue(key))) if number * BLOCK < self.n and self.state.containsKey(key) else []
        return self.blocks[number]

    def __getitem__(self, at: int) -> Word:
        return self.block(at // BLOCK)[at % BLOCK]

    def append(self, word: Word) -> None:
        self.extend([word])

    def extend(self, words: list[Word]) -> None:
        at = 0
        while at < len(words):
            number, block = self.n // BLOCK, self.block(self.n // BLOCK)
            part = words[at : at + BLOCK - len(block)]
            block.extend(part)
            self.changed.add(number)
            self.n += len(part)
            at += len(part)
        if words:
            self.seen = max([*([] if self.seen is None else [self.seen]), *(w[0] for w in words)])
            self.longest = max([self.longest, *(w[1] - w[0] for w in words)])

    def save(self) -> None:
        for number in self.changed:
            self.state.updateValue((self.source, number), tuple(map(list, zip(*self.blocks[number]))))

    def first_from(self, time: float) -> int:
        """The first word that starts at `time` or later."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self[middle][0] < time:
                low = middle + 1
            else:
                high = middle
        return low

    def inside(self, start: float, end: float) -> list[Word]:
        """Words that overlap the span, by start, end and seq."""
        found, at = [], self.first_from(end) - 1
        while at >= 0 and self[at][0] + self.longest > start:
            if self[at][1] > start:
                found.append(self[at])
            at -= 1
        return sorted(found, key=lambda w: w[:3])

    def before(self, time: float, n: int) -> list[str]:
        """Normal forms of the last n words by their end that end by `time`. No word before the one
        at hand ends later than its start and the longest word allow."""
        found: list[Word] = []
        at = self.first_from(time + TOLERANCE) - 1
        while at < self.n - 1 and self[at + 1][0] <= time + TOLERANCE:
            at += 1
        while at >= 0 and n and (len(found) < n or self[at][0] + self.longest >= found[0][1]):
            if self[at][1] <= time + TOLERANCE:
                found = sorted([*found, self[at]], key=lambda w: (w[1], w[0], w[2]))[-n:]
            at -= 1
        return [w[4] for w in found]

    def after(self, time: float, n: int) -> list[str] | None:
        """Normal forms of the first n words that start from `time` on; None while a word that is
        still to come could be one of them."""
        first = self.first_from(time - TOLERANCE)
        if n and (first + n >= self.n or self[first + n][0] <= self[first + n - 1][0]):
            return None
        return self.rest(time, n)

    def rest(self, time: float, n: int) -> list[str]:
        first, found = self.first_from(time - TOLERANCE), []
        at = first
        # Words that start together are ordered by end and seq.
        while at < self.n and (len(found) < n or self[at][0] == found[-1][0]) and n:
            found.append(self[at])
            at += 1
        return [w[4] for w in sorted(found, key=lambda w: w[:3])[:n]]


def _repeated(run: list[str], border: list[str], own: list[str], at_end: bool) -> int:
    """Words at the head (tail) of `run` that repeat the border of the other source, unless `own`
    has them there as well: the longest match."""

    def same(count: int, other: list[str]) -> bool:
        mine = run[len(run) - count :] if at_end else run[:count]
        theirs = other[:count] if at_end else other[len(other) - count :]
        return mine[0] == theirs[0] and mine[-1] == theirs[-1] and mine == theirs and "" not in mine

    longest = next((c for c in range(min(len(run), len(border)), 0, -1) if same(c, border)), 0)
    return 0 if longest and len(own) >= longest and same(longest, own) else longest


class MarkProcessor(StatefulProcessor):
    def __init__(self, settings: ReviewSettings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getMapState("words", "source string, block bigint", "starts array<double>, ends array<double>, seqs array<bigint>, shown array<string>, norms array<string>")
        self.heard = handle.getMapState("heard", "source string", "n bigint, seen double, longest double")
        self.silent = handle.getMapState("silent", "start double", "end double")
        self.edge = handle.getValueState("edge", "end double")
        self.closed = handle.getValueState("closed", "audio_s double")
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        out: list[tuple] = []
        heard = {s: _Words(self.words, s, self.heard.getValue((s,)) if self.heard.containsKey((s,)) else None) for s in SOURCES}
        edge = self.edge.get()[0] if self.edge.exists() else 0.0
        was_closed = self.closed.exists()
        limits = {s: w.seen for s, w in heard.items()}
        spans: list[tuple[float, float]] = []
        # Columns in order as plain lists: a row of a frame costs several times the work on it.
        said = new[(new.kind == "word") & new.source.isin(SOURCES)]
        said = {c: said[c].to_numpy() for c in ("source", "start", "end", "seq", "shown", "norm", "text")}
        order = np.lexsort((said["seq"], said["end"], said["start"]))
        taken: dict[str, list[Word]] = {s: [] for s in SOURCES}
        for source, start, end, seq, shown, norm, text in zip(*(c[order].tolist() for c in said.values())):
            seen = limits[source]
            if was_closed or (seen is not None and start < seen):
                out.append(("late", key[0], start, end, None, None, None, None, source, seq, text))
            else:
                taken[source].append((start, end, int(seq), shown or "", norm or ""))
        for source, words in taken.items():
            heard[source].extend(words)
        for start, end, *_ in taken["publisher"]:
            if end > start:
                if start > edge:
                    spans.append((edge, start))
                edge = max(edge, end)
        closing = new[new.kind == "close"].audio_s.dropna()
        audio = float(closing.iloc[0]) if len(closing) and not was_closed else None
        if audio is not None and audio > edge:
            spans.append((edge, audio))
        spans = [s for s in spans if s[1] - s[0] + TOLERANCE >= self.settings.min_silence_s]
        waiting = [(s[0], e[0]) for s, e in self.silent.iterator()] if not was_closed else []
        for span in sorted(waiting + spans):
            mark = self._mark(span, heard, edge, audio)
            if mark is None:
                self.silent.updateValue((span[0],), (span[1],))
                continue
            if span in waiting:
                self.silent.removeKey((span[0],))
            if mark:
                out.append(("mark", key[0], *mark, None, None, None))
        if audio is not None:
            for state in (self.words, self.heard, self.silent, self.edge):
                state.clear()
            self.closed.update((audio,))
            if "at_ms" in new:
                self.handle.registerTimer(int(new.at_ms.max()) + CLOSED_MS)
        elif not was_closed:
            for source, words in heard.items():
                words.save()
                if words.n:
                    self.heard.updateValue((source,), (words.n, words.seen, words.longest))
            self.edge.update((edge,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    def _mark(self, span: tuple[float, float], heard: dict[str, _Words], edge: float, audio: float | None) -> tuple | None:
        """The mark of a silent span, () if it has none, None while words to come can change it."""
        start, end = span
        publisher, detector = heard["publisher"], heard["detector"]
        pad = self.settings.pad_s
        if audio is None and (detector.seen is None or detector.seen < end or edge < end + pad):
            return None
        words = detector.inside(start, end)
        n = len(words)
        if n < self.settings.min_detector_words:
            return ()
        behind = [w.after(end, n) if audio is None else w.rest(end, n) for w in (publisher, detector)]
        if None in behind:
            return None
        norms = [w[4] for w in words]
        head = _repeated(norms, publisher.before(start, n), detector.before(start, n), False)
        tail = _repeated(norms[head:], behind[0], behind[1], True)
        words = words[head : n - tail]
        if len(words) < self.settings.min_detector_words:
            return ()
        last = end + pad if audio is None else min(audio, end + pad)
        return max(0.0, start - pad), last, start, end, len(words), " ".join(w[3] for w in words if w[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.closed.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def arriving_marks(feed: DataFrame, settings: ReviewSettings = ReviewSettings(), at: str | None = None) -> DataFrame:
    """The streaming `feed` has word rows (kind `word`, item_id, source, seq, text, start, end) and
    closing rows (kind `close`, item_id, audio_s); each source speaks in the order of its starts. Rows
    of kind `mark` come once each, as soon as they are final, and are those of `build_review`; rows of
    kind `late` are words that start before what their source had said in earlier batches, or follow
    the closing. With `at`, the column of the feed's watermark, a closed recording is forgotten a day
    after its closing; without it a small note stays. Needs the RocksDB state store."""
    shown = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = normalized(feed.withColumn("text", F.coalesce("text", F.lit(""))), "text", "norm").withColumn("shown", shown)
    times = [] if at is None else [F.col(at), F.unix_millis(at).alias("at_ms")]
    rows = rows.select("kind", "item_id", "source", "seq", "text", "start", "end", "audio_s", "shown", "norm", *times)
    columns = COLUMNS.format(key=feed.schema["item_id"].dataType.simpleString())
    return rows.groupBy("item_id").transformWithStateInPandas(MarkProcessor(settings), columns, "append", "none" if at is None else "eventTime")


def incremental_marks(feed: DataFrame, folder: str, checkpoint: str, settings: ReviewSettings = ReviewSettings(), at: str | None = None):
    """A writer of `arriving_marks` below `folder`, by kind; the sink's log makes each row come once."""
    rows = arriving_marks(feed, settings, at)
    return rows.writeStream.format("parquet").option("path", folder).partitionBy("kind").option("checkpointLocation", checkpoint)


def written(spark: SparkSession, folder: str, kind: str, key: str = "bigint") -> DataFrame:
    """The rows of one kind that the writer has written so far."""
    schema = COLUMNS.format(key=key)
    rows = spark.read.schema(schema).parquet(folder).where(F.col("kind") == kind)
    return rows.select("item_id", "source", "seq", "text", "start", "end") if kind == "late" else rows.drop("kind", "source", "seq", "text")
