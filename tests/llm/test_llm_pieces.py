import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from spanloom.llm import pieces
from spanloom.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  two  spaces ", "Hello world, hello World!\n\nnew\tline", "▁mark ▁▁", "日本語テキスト と 漢字", "naïve café 😀 \U0001f9ff", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300 + " y", "\x00\x01 ﬁ ½", "http://a.b/c?d=e&f=1234567890", "ununun unun un"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def unigram():
    """A UNIGRAM model of given pieces."""
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.unk_surface = " ⁇ "
    for text, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=text, score=0, type=kind)
    for i, text in enumerate(["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ca", "▁c"]):
        model.pieces.add(piece=text, score=-1.0 - 0.37 * (i % 7) - 0.11 * i, type=1)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = True
    return model.SerializeToString()


def test_bpe_like_the_library(library, spark):
    model, known = pieces.PieceModel(pieces._model(PATH)), {}
    texts = TEXTS + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    found = model.encode(texts, known)
    assert [f.tolist() for f in found] == library.encode(texts)
    assert model.decode(np.concatenate(found), np.array([len(f) for f in found])) == library.decode([f.tolist() for f in found])


def test_unigram_like_the_library():
    proto = unigram()
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.PieceModel(proto)
    texts = ["abc abca cab", "", "zz abz", "  ab   c ", "cabcabcabbbca", "z", "a"]
    assert [f.tolist() for f in model.encode(texts, {})] == library.encode(texts)


def test_states_are_shared_between_words():
    model = pieces.PieceModel(pieces._model(PATH))
    ends = []
    step = model._bpe_states
    model._bpe_states = lambda word, end, *states: (ends.append(end), step(word, end, *states))
    dict(model.encode_words(["▁token", "▁tokens", "▁tokenss", "▁tom"]))
    assert ends == [1, 7, 8, 4]  # each word begins where it leaves the word before it


def test_words_are_forgotten_within_the_bound(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 3)
    monkeypatch.setattr(pieces, "KNOWN_PAIRS", 5)
    model, known = pieces.PieceModel(pieces._model(PATH)), {}
    for text in TEXTS:
        assert model.encode([text], known)[0].tolist() == library.encode(text)


def test_columns_and_edges(spark, docs, library):
    rows = [(1, None), (2, ""), (3, "ok ok"), (3, "ok ok"), (None, "long " * 20000)]
    df = docs(rows)
    encoded = pieces.encode(df, PATH, keep=("doc_id", "name", "_bucket"))
    assert encoded.columns == ["doc_id", "name", "_bucket", "ids"]
    back = pieces.decode(encoded, PATH, keep=("doc_id", "ids")).collect()
    assert sorted((str(r.doc_id), r.ids) for r in back) == sorted((str(i), library.encode(t or "")) for i, t in rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(digest(r.decoded) for r in back) == sorted(digest(t or "") for _, t in rows)
    both = pieces.round_trip(df, PATH, keep=("doc_id", "name")).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both) == sorted((str(r.doc_id), r.ids, r.decoded) for r in back)
    assert pieces.encode(docs([]), PATH).collect() == [] == pieces.round_trip(docs([]), PATH).collect()
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert pieces.decode(none, PATH).collect()[0].decoded == ""
