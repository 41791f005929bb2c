import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanloom.llm import tokenids
from spanloom.llm.common import table
from spanloom.session import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    library = Tokenizer.from_file(PATH)
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(12)
    for n in (1, 7, 511, 512, 513, 5000):
        ids = rng.integers(0, 1 << rng.choice([4, 8, 16, 24, 31]), n).astype(np.uint32)
        ids[rng.integers(0, n)] = (1 << 32) - 1
        levels = tokenids.pack(ids)
        assert (tokenids.unpack(levels) == ids).all()
        assert [tokenids.token_at(levels, i) for i in range(n)] == ids.tolist()
    assert len(tokenids.unpack(tokenids.pack(np.zeros(0, dtype=np.uint32)))) == 0


def test_words_like_the_library():
    encoder = tokenids.WordEncoder(open(PATH, encoding="utf-8").read())
    texts = ["", " ", "a", "it's  two", " x y ", "tab\t end\n new 12 34 !? 'll", "naïve 日本 語", "a\x1c b \xa0c d", "<|endoftext|> x <|endoftext|>", "a <|endoftext|> b", " x<|endoftext|>y  z", "<|endoftext|", "we're o'clock' l'été, x'' a-b- $$$ c$$$ ...d x² ½, ﬁ."]
    assert [f.tolist() for f in encoder.encode(texts, 2)] == [ids_of(t) for t in texts]
    assert 50256 in ids_of("a <|endoftext|> b")


def check(spark, rows, df, segment):
    path = scratch(spark, "token-ids")
    tokenids.write_token_ids(df, PATH, path, 2, segment)
    rows = sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    every = [x for _, t in rows for x in ids_of(t)]
    want, at = [], 0
    for i, t in rows:
        ids = ids_of(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = tokenids.read_documents(spark, path).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    places = sorted(random.Random(13).sample(range(len(every)), min(50, len(every)))) if every else []
    asked = spark.createDataFrame([(p,) for p in [*places, *places, len(every), -1]], "position bigint")
    found = {r.position: r.token_id for r in tokenids.read_tokens(spark, path, asked, block=64).collect()}
    assert found == {p: every[p] for p in places}


def test_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    check(spark, [tuple(r) for r in df.select("doc_id", "text").collect()], df, 3000)


def test_edges(spark, docs):
    rows = [(5, "five five"), (1, None), (2, ""), (2, ""), (None, "none"), (9, "word " * 5000), (-3, "x"), (4, "end <|endoftext|> of text"), (6, "<|endoftext|>")]
    check(spark, rows, docs(rows), 100)
    check(spark, [], docs([]), 100)


def test_the_library_is_asked_for_few_words_at_a_time(monkeypatch):
    class Asked:
        def __init__(self, library):
            self.library, self.pre_tokenizer, self.most = library, library.pre_tokenizer, 0

        def encode_batch_fast(self, words, **options):
            self.most = max(self.most, len(words))
            self.library.pre_tokenizer = self.pre_tokenizer
            return self.library.encode_batch_fast(words, **options)

    monkeypatch.setattr(tokenids, "ASKED", 4)
    encoder = tokenids.WordEncoder(open(PATH, encoding="utf-8").read())
    encoder.library = Asked(encoder.library)
    texts = [" ".join(f"word{chr(97 + i)} {i}x, tail{chr(97 + i)}." for i in range(20)), *["x y"] * 9]
    assert [f.tolist() for f in encoder.encode(texts, 2)] == [ids_of(t) for t in texts]
    assert encoder.library.most == 4 and encoder.known
    encoder.forget()
    assert not (encoder.known or encoder.stems or encoder.tails)


def test_words_around_line_ends_are_asked_for_alone(monkeypatch):
    class Asked:
        def __init__(self, library):
            self.library, self.pre_tokenizer, self.words = library, library.pre_tokenizer, []

        def encode_batch_fast(self, words, **options):
            self.words += words
            self.library.pre_tokenizer = self.pre_tokenizer
            return self.library.encode_batch_fast(words, **options)

    encoder = tokenids.WordEncoder(open(PATH, encoding="utf-8").read())
    encoder.library = Asked(encoder.library)
    texts = ["One two.\nThree two,\nfour", "Three\ntwo. four", "\nfour two", "four\n\ntwo", "'s\n's x", "4\nfour\n.", "", "\n"]
    assert [f.tolist() for f in encoder.encode(texts[:2], 2)] == [ids_of(t) for t in texts[:2]]
    assert sorted(encoder.library.words) == sorted(["One", " two", "Three", "four", " four", "two", "", ".", ","])
    assert [f.tolist() for f in encoder.encode(texts, 2)] == [ids_of(t) for t in texts]


def test_a_task_uses_one_thread_of_the_library(monkeypatch):
    import os

    import pyspark

    class Context:
        @staticmethod
        def get():
            return type("Part", (), {"partitionId": staticmethod(lambda: 0)})

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    list(tokenids._segments(open(PATH, encoding="utf-8").read(), 2, 10)(iter(())))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
