import public_tokenizers
import tiktoken  # noqa: F401 - the encoder that the counts come from
from tokenizers import Tokenizer

from spanloom.llm import lengths
from spanloom.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_like_another_encoder(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.select("text").collect())
    assert sorted(r.n_tokens for r in lengths.token_lengths(docs, RANKS, public_tokenizers.PATTERN).collect()) == want


def test_histogram_answers_every_limit(spark):
    import random

    rnd = random.Random(19)
    sizes = [rnd.choice([0, 1, 5, 300, 300, rnd.randrange(2000)]) for _ in range(400)] + [None]
    df = spark.createDataFrame([(s,) for s in sizes], "n_tokens int")
    bars = lengths.length_histogram(df)
    sizes = [s or 0 for s in sizes]
    rows = {r.n_tokens: r for r in bars.collect()}
    assert set(rows) == set(sizes)
    for limit, r in rows.items():
        assert r.docs == sizes.count(limit) and r.docs_longer == sum(s > limit for s in sizes)
        assert r.tokens_longer == sum(s for s in sizes if s > limit) and r.tokens_total == sum(sizes)
        assert r.truncated_tokens == sum(min(s, limit) for s in sizes) and r.docs_at_most == sum(s <= limit for s in sizes)
        assert abs(r.docs_share - sum(s <= limit for s in sizes) / len(sizes)) < 1e-12
    limits = spark.createDataFrame([(x,) for x in (0, 3, 299, 301, 1024, 99999)], "context_limit int")
    for r in lengths.at_limits(bars, limits).collect():
        assert r.truncated_tokens == sum(min(s, r.context_limit) for s in sizes), r
        assert r.docs_longer == sum(s > r.context_limit for s in sizes)


def test_edges(spark, docs):
    assert lengths.length_histogram(lengths.token_lengths(docs([]), RANKS, public_tokenizers.PATTERN)).collect() == []
    bars = lengths.length_histogram(lengths.token_lengths(docs([(1, None), (2, ""), (2, "a")]), RANKS, public_tokenizers.PATTERN)).collect()
    assert sorted((r.n_tokens, r.docs) for r in bars) == [(0, 2), (1, 1)]
