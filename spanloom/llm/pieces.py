"""SentencePiece encoding and decoding with forward states shared between words.

The text is normalised as the model says and cut into marked words (runs of the word mark and what
follows). The distinct words of a slice of text are sorted, which lays them out as the depth-first
order of their trie: the forward states of the prefix that a word shares with the one before it are
kept, and only the rest of the word is worked out.

A forward state is what Viterbi keeps for a prefix. For a UNIGRAM model that is the best score and
its last piece. For a BPE model, whose result is the order of merges and not a best sum, it is the
last piece of the prefix's own encoding: a sequence of pieces is what the merges give exactly when
each adjacent pair is what the merges give for the two pieces' text, so for each prefix one candidate
fits the state before it. Both kinds give the ids of the model's own encoder.

No shuffle: words are worked out where the text is read. The table of known words is bounded and
only saves time.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanloom.llm.common import batch_of, pieces, ready, strings

MARK = "▁"
# Entries of about 250 and 120 bytes: some 40 MB of each table in a Python worker.
KNOWN_WORDS = 150_000
KNOWN_PAIRS = 300_000
SLICE = 12 << 20
SHORT, NONE, NEVER = (1, 2), {}, float("inf")
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _packed(i: int) -> bytes:
    return i.to_bytes(4, "little")


class PieceModel:
    """Vocabulary and rules of a SentencePiece model, given as the file's content."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto.FromString(proto)
        kinds = pb.TrainerSpec
        if spec.trainer_spec.model_type not in (kinds.UNIGRAM, kinds.BPE):
            raise ValueError("only UNIGRAM and BPE models have pieces to choose between")
        if spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("word marks at the end of words are not supported")
        self.bpe = spec.trainer_spec.model_type == kinds.BPE
        self.normalise = sentencepiece.SentencePieceProcessor(model_proto=proto).normalize
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        kind = pb.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.unknown, self.bytes = 0, {}
        self.text: list[bytes] = []  # what each id decodes to
        lowest = 0.0
        for i, piece in enumerate(spec.pieces):
            if piece.type in (kind.NORMAL, kind.USER_DEFINED):
                self.ids[piece.piece], self.scores[piece.piece] = i, piece.score
                lowest = min(lowest, piece.score)
            elif piece.type == kind.BYTE:
                self.bytes[int(piece.piece[1:-1], 16)] = i
            elif piece.type == kind.UNKNOWN:
                self.unknown = i
            shown = {kind.CONTROL: "", kind.UNKNOWN: spec.trainer_spec.unk_surface}.get(piece.type, piece.piece.replace(MARK, " "))
            self.text.append(bytes([int(piece.piece[1:-1], 16)]) if piece.type == kind.BYTE else shown.encode())
        self.piece_sizes = np.array([len(t) for t in self.text], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.byte_fallback = spec.trainer_spec.byte_fallback
        self.unknown_score = lowest - 10.0
        self.longest = max(map(len, self.ids), default=1)
        # Words can be worked out one by one if no piece has a word mark after another character.
        self.split = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.ranks = {piece: -score for piece, score in self.scores.items()}
        self.packed = {piece: _packed(i) for piece, i in self.ids.items()}
        # By the last three characters of a prefix, how long pieces that end so can be.
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], {1, 2}).add(len(piece))
        self.sizes = {end: tuple(sorted(sizes)) for end, sizes in ends.items()}
        # piece -> piece before it -> whether they fit
        self.after: dict[str, dict[str, bool]] = {piece: {} for piece in self.ids}
        self.pairs = 0

    # -- BPE --

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the adjacent pair with the best piece, leftmost."""
        parts, rank = list(text), self.ranks.get
        ranks = [rank(a + b, NEVER) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NEVER)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether merging leaves `before` and `piece` side by side (`before` empty: piece alone)."""
        if self.pairs >= KNOWN_PAIRS:
            self.pairs = 0
            for others in self.after.values():
                others.clear()
        self.pairs += 1
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.after.setdefault(piece, {})[before] = found
        return found

    def _bpe_states(self, word: str, end: int, last: list, back: list, best: list) -> None:
        """Append the states of the prefixes of `word` from `end` characters on."""
        after, sizes, fits = self.after.get, self.sizes.get, self.fits
        for end in range(end, len(word) + 1):
            for size in sizes(word[end - 3 if end > 3 else 0 : end], SHORT):
                start = end - size
                if start < 0:
                    continue
                piece = word[start:end]
                known = after(piece)
                if known is None:
                    if size > 1:
                        continue  # not in the vocabulary; a single character is a piece in any case
                    known = NONE
                before = last[start]
                fit = known.get(before)
                if fit or (fit is None and fits(before, piece)):
                    last.append(piece)
                    back.append(start)
                    break
            else:
                raise AssertionError(f"no piece ends {word[:end]!r}")

    # -- UNIGRAM --

    def _unigram_states(self, word: str, end: int, last: list, back: list, best: list) -> None:
        for end in range(end, len(word) + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                score = self.scores.get(piece)
                if score is None:
                    if end - start > 1:
                        continue
                    score = self.unknown_score
                total = best[start] + score
                if found is None or total > found[0]:
                    found = (total, piece, start)
            best.append(found[0])
            last.append(found[1])
            back.append(found[2])

    # -- both --

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of the sorted distinct words with its ids (32-bit little endian). `last`, `back` and
        `best` are the forward states along the path from the root of the words' trie."""
        states = self._bpe_states if self.bpe else self._unigram_states
        last, back, best = [""], [0], [0.0]
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], best[shared + 1 :]
            states(word, shared + 1, last, back, best)
            at, found = len(word), []
            while at:
                found.append(last[at])
                at = back[at]
            found.reverse()
            before = word
            yield word, self._ids(found)

    def _ids(self, parts: list[str]) -> bytes:
        try:
            return b"".join(map(self.packed.__getitem__, parts))
        except KeyError:
            pass
        out, was_unknown = [], False
        for part in parts:
            known = self.packed.get(part)
            if known is not None:
                out.append(known)
            elif self.byte_fallback:
                out += [_packed(self.bytes[b]) for b in part.encode()]
            elif not was_unknown:
                out.append(_packed(self.unknown))  # unknown characters in a row are one piece
            was_unknown = known is None
        return b"".join(out)

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[np.ndarray]:
        """Ids of each text. `known` is filled with words and is emptied when it is full."""
        cut = WORDS.findall if self.split else (lambda t: [t] if t else [])
        texts = self.normalise(texts) if texts else []
        new: set[str] = set()
        for text in texts:
            new.update(cut(text))
        missing = new - known.keys()
        if len(known) + len(missing) > KNOWN_WORDS:
            known.clear()
            missing = new
        known.update(self.encode_words(sorted(missing)))
        return [np.frombuffer(b"".join(map(known.__getitem__, cut(text))), dtype="<i4") for text in texts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids that follow each other, `counts` of them a text: the pieces' bytes are
        gathered from one string of all pieces."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.text):
            raise IndexError("an id is outside the vocabulary")
        sizes = self.piece_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.piece_starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.piece_bytes[places].tobytes()
        borders = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in pairwise(borders)]
        return [text[1:] if self.dummy and text[:1] == " " else text for text in texts]


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `limit` bytes: the more words are sorted at a time, the more
    prefixes they share."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _encoded(model: PieceModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with `ids` in place of the text in the first column."""
    known: dict[str, bytes] = {}
    collecting = gc.isenabled()
    gc.disable()  # nothing here makes cycles, and going through the tables of words takes long
    try:
        for batch in _gathered(pieces(batches, "text", SLICE), SLICE):
            found = model.encode(strings(batch, "text"), known)
            offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, dtype="<i4"), type=pa.int32())
            del found
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offsets, flat)], names=[*batch.schema.names[1:], "ids"])
    finally:
        if collecting:
            gc.enable()


def _decoded(model: PieceModel, ids: pa.ListArray) -> pa.Array:
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return pa.array(model.decode(ids.flatten().to_numpy(zero_copy_only=False), counts), type=pa.string())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, 64):
        yield batch.slice(i, 64)


def _encode(proto: bytes):
    return lambda batches: _encoded(PieceModel(proto), batches)


def _decode(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(proto)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], _decoded(model, part.column(0))], names=[*part.schema.names[1:], "decoded"])

    return run


def _round_trip(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(proto)
        for batch in _encoded(model, batches):
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(model, part.column(part.num_columns - 1))], names=[*part.schema.names, "decoded"])

    return run


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _types(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*columns).schema.fields)


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `ids` (array of INT): the ids that the model's own encoder gives for
    the whole text. Null and empty texts have no ids. The model is read here, once, and travels with
    the tasks. An empty table gives no rows."""
    ready(docs.sparkSession)
    taken = docs.select(docs[text].alias("text"), *keep)
    return taken.mapInArrow(_encode(_model(model_path)), _types(docs, list(keep)) + "ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `decoded`: the text of the ids. Null ids give the empty text; bytes
    that are no UTF-8 become U+FFFD; an id outside the vocabulary is an error."""
    ready(encoded.sparkSession)
    taken = encoded.select(ids, *keep)
    return taken.mapInArrow(_decode(_model(model_path)), _types(encoded, list(keep)) + "decoded string")


def round_trip(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `ids` as `encode` gives them and `decoded` as `decode` does, by one Python
    process for each task instead of two."""
    ready(docs.sparkSession)
    taken = docs.select(docs[text].alias("text"), *keep)
    return taken.mapInArrow(_round_trip(_model(model_path)), _types(docs, list(keep)) + "ids array<int>, decoded string")
