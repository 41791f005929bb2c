"""Sequence scoring: edit distance, the edit-operation table, error rates, recall, offsets.

A pair is one row: (keys, ref ARRAY<STRING>, hyp ARRAY<STRING>). Pairs that need no search (an
empty side, equal sides) are answered by column expressions; the rest pass through one Arrow
kernel that holds a single pair at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spanloom.functions.text import tokenize_raw, with_norm_tokens
from spanloom.operators.scans import Scan, bucketed_scan
from spanloom.session import settle, spread

DIAGONAL, DELETE, INSERT = 0, 1, 2
FAR = np.int32(1 << 29)
NATIVE_CHARS = 2_000
VERSION = "normaliser"
KEPT_BITS = 1 << 27  # cells of a table whose rows of bits are kept whole
LONG_TOKENS = 300_000  # of both sides (some 15 s of one task); a longer pair is traced by several tasks


def token_ids(ref: Sequence[str], hyp: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, _ = pd.factorize(np.concatenate([np.asarray(ref, dtype=object), np.asarray(hyp, dtype=object)]))
    return codes[: len(ref)], codes[len(ref):]


class Band:
    """Rows of the edit table restricted to |j - i - shift| <= reach, one row at a time.

    Column o of row i stands for j = i - low + o. A distance not above the band's slack proves
    every cell on an optimal path lies inside, so the values and choices there are those of the
    full table; otherwise the band is doubled.
    """

    def __init__(self, ref: np.ndarray, hyp: np.ndarray, slack: int) -> None:
        self.ref, self.m, self.top = ref, len(hyp), 0  # ref[0] is the token of row top + 1
        n, m = len(ref), len(hyp)
        self.low, high = max(0, n - m) + slack, max(0, m - n) + slack
        self.width = self.low + high + 1
        self.steps = np.arange(self.width, dtype=np.int32)
        # hyp padded so that row i reads one slice.
        self.padded = np.full(m + 2 * self.width + n + 2, -1, dtype=np.int64)
        self.base = self.width + 1
        self.padded[self.base : self.base + m] = hyp

    def first(self) -> np.ndarray:
        j = self.steps - self.low
        return np.where((j >= 0) & (j <= self.m), j, FAR).astype(np.int32)

    def next(self, prev: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row i and its choices: diagonal before deletion before insertion."""
        first_j = i - self.low
        at = self.base + first_j - 1
        lo = max(at, 0)
        piece = np.full(self.width, -1, dtype=np.int64)
        piece[lo - at :] = self.padded[lo : at + self.width]
        diagonal = prev + (piece != self.ref[i - 1 - self.top])
        up = np.append(prev[1:], FAR) + 1
        row = np.minimum(diagonal, up).astype(np.int32)
        j = self.steps + first_j
        outside = (j < 0) | (j > self.m)
        row[outside] = FAR
        row = np.minimum.accumulate(row - self.steps) + self.steps
        row[outside] = FAR
        choice = np.where(row == diagonal, DIAGONAL, np.where(row == up, DELETE, INSERT)).astype(np.uint8)
        return np.minimum(row, FAR), choice


class BitRows:
    """The whole edit table by rows of bits: bit j - 1 of a row stands for token j of hyp. A row is two
    integers (where its costs rise from left to right, where they fall), and a step to the next one is a
    few operations on integers of len(hyp) bits, whatever the band would be."""

    def __init__(self, hyp: Sequence[int]) -> None:
        self.places: dict[int, int] = {}
        for j, token in enumerate(hyp):
            self.places.setdefault(token, []).append(j)
        self.places = {token: _bits(at, len(hyp)) for token, at in self.places.items()}
        self.m, self.every = len(hyp), (1 << len(hyp)) - 1

    def first(self) -> tuple[int, int]:
        return self.every, 0

    def next(self, rises: int, falls: int, token: int) -> tuple[int, int, int, int]:
        """The next row, where it costs what the row above does one column to the left, and where it costs
        one more than the row above."""
        match, every = self.places.get(token, 0), self.every
        same = ((((match & rises) + rises) ^ rises) | match | falls) & every
        up = falls | ((same | rises) ^ every)
        right_up = (up << 1 | 1) & every
        return (rises & same) << 1 & every | ((same | right_up) ^ every), right_up & same, same, up

    def costs(self, rises: int, falls: int, i: int) -> np.ndarray:
        """The costs of row i in columns 0 to m."""
        steps = _unpacked(rises, self.m).astype(np.int32) - _unpacked(falls, self.m)
        return np.concatenate([[i], i + np.cumsum(steps)]).astype(np.int32)


def _bits(at: Sequence[int], size: int) -> int:
    if len(at) < 16:
        value = 0
        for j in at:
            value |= 1 << j
        return value
    flags = np.zeros(size, dtype=np.uint8)
    flags[at] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _unpacked(value: int, size: int) -> np.ndarray:
    packed = np.frombuffer(value.to_bytes(size + 7 >> 3, "little"), dtype=np.uint8)
    return np.unpackbits(packed, count=size, bitorder="little")


def fitted(ref: np.ndarray, hyp: np.ndarray, rows: Callable[[Band], int]) -> tuple[Band, dict[int, np.ndarray], int]:
    """The narrowest doubled band that is exact, every `rows`-th of its rows, and the distance."""
    n, m = len(ref), len(hyp)
    found, slack = _distance_of(ref, hyp), 16
    # A path that leaves the band costs at least |n - m| + 2 (slack + 1).
    while found > abs(n - m) + 2 * slack + 1:
        slack *= 4
    band = Band(ref, hyp, min(slack, n + m))
    bits, every, kept = BitRows(hyp.tolist()), rows(band), {}
    row = bits.first()
    for i, token in enumerate(ref.tolist()):
        if i % every == 0:
            j = band.steps - band.low + i
            kept[i] = np.where((j >= 0) & (j <= m), bits.costs(*row, i)[np.clip(j, 0, m)], FAR).astype(np.int32)
        row = bits.next(*row, token)[:2]
    return band, kept, found


def _distance_of(ref: np.ndarray, hyp: np.ndarray) -> int:
    bits = BitRows(hyp.tolist())
    row = bits.first()
    for token in ref.tolist():
        row = bits.next(*row, token)[:2]
    return len(ref) + row[0].bit_count() - row[1].bit_count()


def distance(ref: Sequence[str], hyp: Sequence[str]) -> int:
    a, b = token_ids(ref, hyp)
    if len(a) == 0 or len(b) == 0:
        return len(a) + len(b)
    return _distance_of(a, b)


def common_ending(a: np.ndarray, b: np.ndarray) -> int:
    """Equal last tokens: they always take the diagonal, so they need no table."""
    limit = min(len(a), len(b))
    if not limit:
        return 0
    differs = np.flatnonzero(a[len(a) - limit :][::-1] != b[len(b) - limit :][::-1])
    return int(differs[0]) if len(differs) else limit


def traced(a: Sequence[int], b: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`trace` of token numbers. The rows of bits are kept for one block at a time: the forward pass keeps
    the top row of each block, and the walk back works out the block that it is in once more."""
    n, m = len(a), len(b)
    same = common_ending(a, b)
    tail_i, tail_j = n - 1 - np.arange(same), m - 1 - np.arange(same)
    i, j = n - same, m - same
    kinds, at_i, at_j = [DIAGONAL] * same, tail_i.tolist(), tail_j.tolist()
    if i and j:
        ref, hyp = a[:i].tolist(), b[:j].tolist()
        rows = BitRows(hyp)
        every = i if i * j <= KEPT_BITS else max(1, int(np.sqrt(i)))
        kept, row = {}, rows.first()
        for r in range(i):
            if r % every == 0:
                kept[r] = row
                if r + every >= i:
                    break
            row = rows.next(*row, ref[r])[:2]
        top, block = i, []
        while i and j:
            if i <= top:
                top = (i - 1) // every * every
                row, block = kept[top], []
                for r in range(top, min(top + every, len(ref))):
                    *row, diagonal, up = rows.next(*row, ref[r])
                    block.append((diagonal, up))
            diagonal, up = block[i - top - 1]
            # Equal tokens and cells that cost more than the one diagonally before go there.
            if ref[i - 1] == hyp[j - 1] or not diagonal >> j - 1 & 1:
                step = DIAGONAL
            else:
                step = DELETE if up >> j - 1 & 1 else INSERT
            kinds.append(step)
            at_i.append(i - 1 if step != INSERT else -1)
            at_j.append(j - 1 if step != DELETE else -1)
            i -= step != INSERT
            j -= step != DELETE
    kinds += [DELETE] * i + [INSERT] * j
    at_i += list(range(i - 1, -1, -1)) + [-1] * j
    at_j += [-1] * i + list(range(j - 1, -1, -1))
    return np.array(kinds[::-1], dtype=np.int8), np.array(at_i[::-1], dtype=np.int64), np.array(at_j[::-1], dtype=np.int64)


def trace(ref: Sequence[str], hyp: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(choice, i, j) per step in reference order; i, j are -1 where the side is not consumed. A
    diagonal step goes before a deletion, that before an insertion."""
    return traced(*token_ids(ref, hyp))


def _chunks(equal: np.ndarray, anchor_run: int) -> np.ndarray:
    """Chunk number per step, -1 inside a run of at least anchor_run equal steps."""
    if not len(equal):
        return np.zeros(0, dtype=np.int64)
    run = np.concatenate([[0], np.cumsum(equal[1:] != equal[:-1])])
    anchored = equal & (np.bincount(run)[run] >= anchor_run)
    opened = np.concatenate([[not anchored[0]], anchored[:-1] & ~anchored[1:]])
    return np.where(anchored, -1, np.cumsum(opened) - 1)


OPS = ("op_seq", "kind", "ref_at", "hyp_at", "ref_token", "hyp_token", "chunk")
KINDS = np.array(["equal", "sub", "del", "ins"], dtype=object)
STEPS_A_BATCH = 1 << 16


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins and ends among the values, and the values."""
    lists = pa.concat_arrays([column])  # without an offset
    return lists.offsets.to_numpy(), lists.values


def _ops_kernel(keys: Sequence[str], anchor_run: int):
    def steps_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        choice, i, j = traced(a, b)
        both = choice == DIAGONAL
        equal = np.zeros(len(choice), dtype=bool)
        equal[both] = a[i[both]] == b[j[both]]
        kind = np.where(choice == DELETE, 2, np.where(choice == INSERT, 3, np.where(equal, 0, 1)))
        return kind, i, j, _chunks(equal, anchor_run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ref_from, ref), (hyp_from, hyp) = (_listed(batch.column(c)) for c in ("ref", "hyp"))
            codes = pa.concat_arrays([ref, hyp]).dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = len(ref)

            def flushed(parts: list) -> pa.RecordBatch:
                pair, seq, kind, i, j, chunk, at_ref, at_hyp = (np.concatenate(x) for x in zip(*parts))
                number = lambda x: pa.array(x, mask=x < 0, type=pa.int64())
                token = lambda values, at, x: values.take(pa.array(at, mask=x < 0, type=pa.int64()))
                named = pa.array(KINDS).take(pa.array(kind))
                columns = [*[batch.column(k).take(pa.array(pair)) for k in keys], pa.array(seq), named, number(i), number(j), token(ref, at_ref, i), token(hyp, at_hyp, j), number(chunk)]
                return pa.RecordBatch.from_arrays(columns, names=[*keys, *OPS])

            parts, size = [], 0
            for p in range(batch.num_rows):
                r, h = int(ref_from[p]), int(hyp_from[p])
                kind, i, j, chunk = steps_of(codes[r : ref_from[p + 1]], codes[first + h : first + hyp_from[p + 1]])
                parts.append((np.full(len(kind), p), np.arange(len(kind)), kind, i, j, chunk, i + r, j + h))
                size += len(kind)
                if size >= STEPS_A_BATCH:
                    yield flushed(parts)
                    parts, size = [], 0
            if parts:
                yield flushed(parts)

    return run


def edit_ops(pairs: DataFrame, keys: Sequence[str] = ("item_id", "variant"), anchor_run: int = 5, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """One row per alignment step: op_seq, kind (equal, sub, del, ins), positions, tokens, and
    `chunk`, the stretch between anchors it belongs to (NULL inside an anchor). Pairs of more than
    `long_tokens` tokens are cut into blocks that several tasks trace; whether there are any is looked
    up here, so give a settled table."""
    from spanloom.operators.long_align import long_edit_ops

    if anchor_run < 1:
        raise ValueError("anchor_run must be at least 1")
    keys = list(keys)
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", op_seq long, kind string, ref_at long, hyp_at long, ref_token string, hyp_token string, chunk long"
    )
    easy = (F.size("ref") == 0) | (F.size("hyp") == 0) | (F.col("ref") == F.col("hyp"))
    is_long = F.size("ref") + F.size("hyp") > long_tokens
    hard = spread(pairs.where(~easy & ~is_long).select(*keys, "ref", "hyp"), *keys).mapInArrow(_ops_kernel(keys, anchor_run), schema)
    alone = F.when(F.size("ref") == 0, "ins").when(F.size("hyp") == 0, "del").otherwise("equal")
    longer = F.when(F.size("ref") == 0, F.col("hyp")).otherwise(F.col("ref"))
    steps = pairs.where(easy).select(*keys, F.size("ref").alias("n"), alone.alias("kind"), F.posexplode(longer).alias("at", "token"))
    at = F.col("at").cast("long")
    in_ref, in_hyp = F.col("kind") != "ins", F.col("kind") != "del"
    anchored = (F.col("kind") == "equal") & (F.col("n") >= anchor_run)
    simple = steps.select(
        *keys, at.alias("op_seq"), "kind", F.when(in_ref, at).alias("ref_at"), F.when(in_hyp, at).alias("hyp_at"),
        F.when(in_ref, F.col("token")).alias("ref_token"), F.when(in_hyp, F.col("token")).alias("hyp_token"),
        F.when(~anchored, F.lit(0).cast("long")).alias("chunk"),
    )
    found = hard.unionByName(simple)
    long = pairs.where(~easy & is_long)
    return found if long.isEmpty() else found.unionByName(long_edit_ops(long, keys, anchor_run))


@F.pandas_udf(LongType())
def _distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([distance(a, b) for a, b in zip(ref, hyp)], dtype="int64")


def token_distance(ref: str = "ref", hyp: str = "hyp", native_tokens: int = 2000) -> Column:
    """Unit-cost edit distance of two token arrays: distinct tokens become code points and Spark's
    own `levenshtein` compares the strings; longer pairs go to the banded kernel."""
    vocabulary = F.array_distinct(F.concat(ref, hyp))
    small = F.size(ref) + F.size(hyp) <= native_tokens

    def encoded(tokens: str) -> Column:
        code = F.transform(tokens, lambda t: F.lpad(F.hex(F.lit(19968) + F.array_position(vocabulary, t)), 4, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")

    long_ref, long_hyp = F.when(~small, F.col(ref)), F.when(~small, F.col(hyp))
    empty = F.array().cast("array<string>")
    kernel = _distance(F.coalesce(long_ref, empty), F.coalesce(long_hyp, empty))
    return F.when(small, F.levenshtein(encoded(ref), encoded(hyp)).cast("long")).otherwise(kernel)


def wer(errors: Column, n_ref: Column, ins: Column) -> Column:
    """0 for two empty sides, NULL for an empty reference with insertions."""
    return F.when(n_ref > 0, errors.cast("double") / n_ref).when(ins > 0, F.lit(None)).otherwise(F.lit(0.0))


def word_errors(pairs: DataFrame, ops: DataFrame, keys: Sequence[str] = ("item_id", "variant")) -> DataFrame:
    keys = list(keys)
    counts = ops.groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("equal", "hits"), ("sub", "sub"), ("del", "dele"), ("ins", "ins"))]
    )
    sized = pairs.select(*keys, F.size("ref").cast("long").alias("n_ref"), F.size("hyp").cast("long").alias("n_hyp"))
    joined = sized.join(counts, keys, "left").na.fill(0, ["hits", "sub", "dele", "ins"])
    return joined.withColumn("wer", wer(F.col("sub") + F.col("dele") + F.col("ins"), F.col("n_ref"), F.col("ins")))


def character_distance(a: str, b: str) -> int:
    """Edit distance of two texts, bit-parallel: a column of the table is two integers of len(a)
    bits (where it rises, where it falls), so a text of 100,000 characters takes seconds."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, character in enumerate(a):
        places[character] = places.get(character, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, score = every, 0, len(a)
    for character in b:
        match = places.get(character, 0)
        zero = (((match & rises) + rises) ^ rises) | match | falls  # diagonal steps that cost nothing
        right_up, right_down = falls | ~(zero | rises) & every, zero & rises
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | 1) & every, right_down << 1 & every
        rises, falls = right_down | ~(zero | right_up) & every, right_up & zero
    return score


@F.pandas_udf(LongType())
def _character_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([character_distance(x, y) for x, y in zip(a, b)], dtype="int64")


def text_distance(a: str, b: str, native_chars: int = NATIVE_CHARS) -> Column:
    """Edit distance of two text columns: Spark's own for short ones, the bit-parallel kernel where the
    table would have more than `native_chars` squared cells."""
    cells = F.length(a).cast("long") * F.length(b)
    small = cells <= native_chars * native_chars
    kernel = _character_distance(F.when(small, F.lit("")).otherwise(F.col(a)), F.when(small, F.lit("")).otherwise(F.col(b)))
    return F.when(small, F.levenshtein(a, b).cast("long")).otherwise(kernel)


def cer_chunked(pairs: DataFrame, ops: DataFrame, keys: Sequence[str] = ("item_id", "variant")) -> DataFrame:
    """Character errors summed over the chunks between anchors, per reference character."""
    keys = list(keys)

    def side(token: str) -> Column:
        piece = F.when(F.col(token).isNotNull(), F.struct("op_seq", F.col(token).alias("t")))
        texts = F.transform(F.array_sort(F.collect_list(piece)), lambda p: F.concat(p["t"], F.lit(" ")))
        return F.array_join(texts, "")

    chunks = ops.where(F.col("chunk").isNotNull()).groupBy(*keys, "chunk").agg(side("ref_token").alias("r"), side("hyp_token").alias("h"))
    errors = chunks.groupBy(*keys).agg(F.sum(text_distance("r", "h")).alias("errors"))
    chars = F.length(F.array_join("ref", " "))
    rate = F.when(chars > 0, F.coalesce("errors", F.lit(0)).cast("double") / chars).when(F.size("hyp") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return pairs.join(errors, keys, "left").select(*keys, rate.alias("cer"))


def per_speaker_recall(ops: DataFrame, ref_speakers: DataFrame, keys: Sequence[str] = ("item_id", "variant")) -> DataFrame:
    """Counts per reference speaker; `ref_speakers` is (item_id, ref_at, speaker). Insertions
    belong to nobody."""
    joined = ops.where(F.col("ref_at").isNotNull()).join(ref_speakers, ["item_id", "ref_at"])
    return joined.groupBy(*keys, "speaker").agg(
        F.count("*").alias("n_tokens"),
        F.count_if(F.col("kind") == "equal").alias("recovered"),
        F.count_if(F.col("kind") == "sub").alias("substituted"),
        F.count_if(F.col("kind") == "del").alias("deleted"),
        F.min("ref_at").alias("first_at"),
    ).withColumn("recall", F.col("recovered").cast("double") / F.col("n_tokens"))


def timestamp_offsets(ops: DataFrame, ref_times: DataFrame, hyp_times: DataFrame, keys: Sequence[str] = ("item_id", "variant")) -> DataFrame:
    """Onset offsets (hypothesis minus reference) over equal steps: (keys, op_seq, offset_s)."""
    hyp_keys = [*keys, "hyp_at"] if "variant" in hyp_times.columns else ["item_id", "hyp_at"]
    equal = ops.where(F.col("kind") == "equal").select(*keys, "op_seq", "ref_at", "hyp_at")
    timed = equal.join(ref_times.select("item_id", "ref_at", F.col("start").alias("rs")), ["item_id", "ref_at"])
    timed = timed.join(hyp_times.select(*hyp_keys, F.col("start").alias("hs")), hyp_keys)
    return timed.select(*keys, "op_seq", (F.col("hs") - F.col("rs")).alias("offset_s"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, n, q0, q1, ...): quantiles of a column that is not negative, interpolated between the two
    ranks around share x (n - 1). Equal values are counted first (combined before the shuffle), ranks
    come from a scan over ranges of values, and only the rows that hold a wanted rank go on: no group
    is sorted or held in one task."""
    keys = list(keys)
    counted = settle(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__c")))
    # 64 ranges for every doubling of the value; zero is below them all.
    ranges = F.coalesce(F.floor(F.log2(F.when(F.col("__x") > 0, F.col("__x"))) * 64), F.lit(-1 << 20))
    ranked = bucketed_scan(counted, keys, ranges.cast("bigint"), ["__x"], [Scan("__first", "sum_before", F.col("__c"))])
    totals = counted.groupBy(*keys).agg(F.sum("__c").alias("n"))
    ranked = ranked.join(totals, keys)
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(share))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("__first") <= rank) & (rank < F.col("__first") + F.col("__c")), F.col("__x"))).alias(f"__{side}{i}"))
    found = ranked.groupBy(*keys, "n").agg(*picks)
    out = []
    for i, share in enumerate(shares):
        at, low, high = (F.col("n") - 1) * F.lit(float(share)), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"q{i}"))
    return found.select(*keys, "n", *out)


def timing(offsets: DataFrame, keys: Sequence[str] = ("item_id", "variant")) -> DataFrame:
    """Count, median and 90 % quantile of the offsets' sizes."""
    sizes = offsets.withColumn("__size", F.abs("offset_s"))
    return exact_quantiles(sizes, "__size", (0.5, 0.9), keys).withColumnsRenamed({"q0": "median_abs_s", "q1": "p90_abs_s"})


def positioned_tokens(rows: DataFrame, order: Sequence[str], tokens: str, name: str, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """Tokens of every row with their position `name` in the key's whole token sequence; the
    columns of the row come along."""
    first = order[0]
    counted = bucketed_scan(
        rows.withColumn("__count", F.size(tokens)), keys, F.floor(F.col(first) / 600).cast("bigint"), list(order), [Scan("__from", "sum_before", F.col("__count"))]
    )
    kept = [c for c in rows.columns if c != tokens]
    exploded = counted.select(*kept, "__from", F.posexplode(tokens).alias("__pos", "token"))
    return exploded.withColumn(name, (F.col("__from") + F.col("__pos")).cast("long")).drop("__from", "__pos")


def token_arrays(positioned: DataFrame, position: str, name: str, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """The token sequence of each key as one array: the row an alignment needs."""
    piece = F.struct(F.col(position).alias("p"), "token")
    return positioned.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["token"]).alias(name))


def word_pairs(
    reference: DataFrame, words: DataFrame, tokenisation: str, spellings: Mapping[str, str] | None = None, settled: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of token arrays per (item, variant) with the positioned tokens of both sides.
    `tokenisation` is raw or norm, with the caller's `spellings`; words carry (item_id, [variant], seq, start, end, text).
    A side named in `settled` (ref, hyp) is written once, for callers that read it again beside the pairs."""

    def tokens(df: DataFrame) -> DataFrame:
        if tokenisation == "raw":
            return df.withColumn("tokens", tokenize_raw("text"))
        # Settled: the numbering reads the tokens twice, and normalising is the dear part.
        return settle(with_norm_tokens(df, "text", "tokens", spellings))

    order = ["start", "end", "seq"]
    ref = positioned_tokens(tokens(reference), order, "tokens", "ref_at")
    hyp = positioned_tokens(tokens(words), order, "tokens", "hyp_at", ["item_id", "variant"])
    ref, hyp = (settle(side.drop("text")) if name in settled else side for name, side in (("ref", ref), ("hyp", hyp)))
    left, right = token_arrays(ref, "ref_at", "ref"), token_arrays(hyp, "hyp_at", "hyp", ["item_id", "variant"])
    empty = F.array().cast("array<string>")
    pairs = left.join(right, "item_id", "full_outer").withColumns({"ref": F.coalesce("ref", empty), "hyp": F.coalesce("hyp", empty)})
    return pairs, ref, hyp


def versions_of(scores: DataFrame) -> list[str]:
    """The column that keeps scores of different normalisers apart, for frames that carry it."""
    return [VERSION] if VERSION in scores.columns else []


def _pooled(grouped: GroupedData, *more: Column) -> DataFrame:
    names = ["n_ref", "n_hyp", "hits", "sub", "dele", "ins"]
    pooled = grouped.agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("items"), *more)
    return pooled.withColumn("wer", F.when(F.col("n_ref") > 0, (F.col("sub") + F.col("dele") + F.col("ins")).cast("double") / F.col("n_ref")))


def pooled_word_errors(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts summed, then the rate; never a mean of rates, nor of different normalisers."""
    return _pooled(scores.groupBy(*dict.fromkeys([*by, *versions_of(scores)])))


def pooled_with_subtotals(scores: DataFrame) -> DataFrame:
    """The pooled report over (group, variant), group, and everything, in one pass; everything of
    each normaliser apart where the scores carry it."""
    version = versions_of(scores)
    sets = [[*version, "group", "variant"], [*version, "group"], version]
    grouped = scores.groupingSets([[F.col(c) for c in each] for each in sets], *sets[0])
    return _pooled(grouped, F.grouping_id().alias("level"))
