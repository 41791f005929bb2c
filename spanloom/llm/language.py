"""Language identification by cross-parsing entropy.

Each language is a bounded sample of labelled text, held as a suffix automaton: from any state, the
next byte either continues a string that occurs in the sample or ends the match. A text is parsed
against each automaton into the longest matches, one after the other; the language whose sample
explains the text with the fewest phrases per byte wins (the number of phrases times the logarithm
of the sample's length, over the text's length, estimates the cross entropy; samples are cut to one
length, so phrases per byte order the languages in the same way).

The sample is the only thing that is bounded (`SAMPLE_BYTES` per language, taken from `SLOTS`
documents chosen by hash, `DOC_CHARS` of each); every text is parsed from its first to its last
byte. Windows of `WINDOW` bytes are parsed side by side in one array step, so phrases end at window
borders, in every language alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import batch_of, pieces, ready, strings

SAMPLE_BYTES = 24_000
SLOTS, DOC_CHARS = 64, 2_000
TABLE_BYTES = 128 << 20  # of all automata together; more languages get shorter samples
WINDOW = 1024
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def plain(text: str) -> bytes:
    """Lower case; ASCII characters that are no letters become spaces."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN)


_PLAIN = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


class SuffixAutomaton:
    """The states of all substrings of `sample`: `step[state * width + symbol]` is four times the
    next state's offset, plus the number of phrases that end: 1 where the match ends and the next one
    starts with this symbol; a symbol that the sample lacks is a phrase and ends the one before it."""

    def __init__(self, sample: bytes) -> None:
        self.symbols = np.zeros(256, dtype=np.int32)
        seen = sorted(set(sample))
        for number, byte in enumerate(seen, 1):
            self.symbols[byte] = number  # 0: a byte that the sample lacks
        self.width = len(seen) + 1
        moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for symbol in self.symbols[np.frombuffer(sample, dtype=np.uint8)].tolist():
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at >= 0:
                reached = moves[at][symbol]
                if length[reached] == length[at] + 1:
                    link[new] = reached
                else:
                    copy = len(moves)
                    moves.append(dict(moves[reached]))
                    link.append(link[reached])
                    length.append(length[at] + 1)
                    while at >= 0 and moves[at].get(symbol) == reached:
                        moves[at][symbol] = copy
                        at = link[at]
                    link[reached] = link[new] = copy
            last = new
        root = np.full(self.width, 2, dtype=np.int32)
        for symbol, state in moves[0].items():
            root[symbol] = 4 * state * self.width + 1
        step = np.tile(root, (len(moves), 1))
        step[0] = 1
        for state, found in enumerate(moves):
            for symbol, target in found.items():
                step[state, symbol] = 4 * target * self.width
        self.step = step.ravel()


def phrases(symbols: np.ndarray, step: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each row of `windows` (bytes, the first `lengths` of a row count; rows ordered by
    falling length) against an automaton's symbols and steps."""
    state = np.zeros(len(windows), dtype=np.int32)
    ended = np.zeros(len(windows), dtype=np.int32)
    columns = np.ascontiguousarray(symbols[windows].T)
    active = np.searchsorted(-lengths, -np.arange(windows.shape[1]), side="left")
    for i in range(windows.shape[1]):
        n = int(active[i])  # rows longer than i
        if n == 0:
            break
        at = state[:n]
        at >>= 2
        at += columns[i, :n]
        at[:] = step.take(at)
        ended[:n] += at & 3
    # A text that ends inside a match has one phrase more; a state over 3 is not the root.
    return ended + (state > 3)


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Sample text per language of `docs` (doc_id, text, lang), without held-out rows. Of each
    language, the document of the smallest hash in each of SLOTS slots gives DOC_CHARS characters:
    what is collected is bounded by the number of languages."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    digest = F.xxhash64("doc_id", "text")
    rows = rows.select("lang", F.pmod(digest, F.lit(SLOTS)).alias("_slot"), digest.alias("_at"), F.substring("text", 1, DOC_CHARS).alias("_text"))
    found = rows.groupBy("lang", "_slot").agg(F.min(F.struct("_at", "_text")).alias("_least")).select("lang", "_slot", F.col("_least._text").alias("_text"))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for row in found.collect():
        by_lang.setdefault(row["lang"], []).append((row["_slot"], row["_text"]))
    samples = {lang: plain("\n".join(text for _, text in sorted(texts))) for lang, texts in by_lang.items()}
    # A sample of n bytes has up to 2n states of up to 4 x (its distinct bytes) bytes.
    bound = min(sample_bytes, TABLE_BYTES // max(1, len(samples)) // (8 * 64))
    return {lang: sample[:bound] for lang, sample in sorted(samples.items()) if sample.strip()}


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, lengths and text numbers of all windows, ordered by falling length."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), dtype=np.uint8)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + number * WINDOW
    length = np.minimum(WINDOW, np.repeat(sizes, counts) - number * WINDOW)
    order = np.argsort(-length, kind="stable")
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[start[order]], length[order], owner[order]


def _predict(automata):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = automata.value
        names = list(languages)
        for batch in pieces(batches, "text"):
            schema = pa.schema([batch.schema.field(1), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrases_per_byte", pa.float64())])
            texts = strings(batch, "text")
            bytes_ = [plain(t) for t in texts]
            sizes = np.array([max(1, len(b)) for b in bytes_], dtype=np.float64)
            windows, lengths, owner = _windows(bytes_)
            rates = np.ones((len(names), len(texts)))
            for k, name in enumerate(names):
                rates[k] = np.bincount(owner, weights=phrases(*languages[name], windows, lengths), minlength=len(texts)) / sizes
            letters = [any(map(str.isalpha, t)) for t in texts]
            best = rates.argmin(axis=0) if names else None
            order = np.sort(rates, axis=0)
            pred, score, rate = [], [], []
            for i, has_letter in enumerate(letters):
                if not has_letter or not names:
                    pred.append(UNKNOWN), score.append(0.0), rate.append(None)
                    continue
                second = order[1, i] if len(names) > 1 else 1.0
                pred.append(names[best[i]])
                score.append(float(min(1.0, max(0.0, 1.0 - order[0, i] / second))))
                rate.append(float(order[0, i]))
            yield batch_of(schema, batch.column(1), pred, score, rate)

    return run


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """One row per row of `docs` (text, and _row, a value of any type that is passed on): _row,
    lang_pred, score, phrases_per_byte.

    lang_pred is the language with the fewest phrases per byte (of equals, the first by name), `und`
    for null, empty and letterless texts or without any sample. score is 1 minus the winner's share
    of the runner-up's phrases, 0 for `und`; phrases_per_byte is the winner's, null for `und`.
    """
    spark = ready(docs.sparkSession)
    # Bounded: TABLE_BYTES over all languages.
    automata = spark.sparkContext.broadcast({lang: (made.symbols, made.step) for lang, made in ((lang, SuffixAutomaton(sample)) for lang, sample in samples.items())})
    docs = docs.select("text", "_row")
    schema = T.StructType([docs.schema["_row"], *(T.StructField(n, t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("phrases_per_byte", T.DoubleType())))])
    return docs.mapInArrow(_predict(automata), schema)


def language_id(docs: DataFrame, labelled: DataFrame | None = None, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases_per_byte per row of `docs` (doc_id, text, lang):
    learned from the rows of `labelled` (by default `docs`) that are not held out. A null doc_id is
    not held out. An empty table gives no rows."""
    samples = learn(docs if labelled is None else labelled, sample_bytes)
    found = identify(docs.select("text", F.col("doc_id").alias("_row")), samples)
    return found.select(F.col("_row").alias("doc_id"), held_out(F.col("_row")).alias("held_out"), "lang_pred", "score", "phrases_per_byte")
