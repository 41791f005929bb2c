import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spanloom.llm import queries, runs


def plain_runs(words, least):
    """All maximal stretches by testing every period, shortest first."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rnd = random.Random(least)
    for _ in range(300):
        docs = [[rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(50))] for _ in range(rnd.randrange(4))]
        docs = [d + [d[i % len(d)] for i in range(rnd.randrange(40))] if d and rnd.random() < 0.4 else d for d in docs]
        ids = np.array([w for d in docs for w in d], dtype=np.int32)
        doc = np.array([k for k, d in enumerate(docs) for _ in d], dtype=np.int64)
        found = {k: [] for k in range(len(docs))}
        for s, n, p in zip(*(a.tolist() for a in runs.find_runs(ids, doc, least))):
            found[int(doc[s])].append((s - int(np.searchsorted(doc, doc[s])), n, p))
        assert [found[k] for k in range(len(docs))] == [plain_runs(d, least) for d in docs]


def test_intervals_in_small_chunks(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 3)
    words = [1, 2, 1, 2, 1, 2, 1, 1, 1, 2, 2] * 4
    found = runs.find_runs(np.array(words, dtype=np.int32), np.zeros(len(words), dtype=np.int64), 4)
    assert list(zip(*(a.tolist() for a in found))) == plain_runs(words, 4)


def collapsed(df, **options):
    rows = runs.collapse_runs(df, **options).collect()
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows]


def plain(rows, least=12):
    out = []
    for i, text in rows:
        words = plain_words(text)
        found = plain_runs(words, least)
        out.append((i, len(words), found, plain_collapsed(words, found)))
    return out


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (4, "x\x0by\x0cz " * 6), (4, "x\x0by\x0cz " * 6), (5, "\x1cé " * 15), (6, "ü " * 12 + "end"), (7, "one two three")]
    assert sorted(collapsed(docs(rows)), key=str) == sorted(plain(rows), key=str)
    assert collapsed(docs([])) == []


def test_very_long_texts(docs):
    text = "w " * 400_000 + "end"
    long = " ".join(str(i % 70_000) for i in range(300_000))
    got = {r[0]: r for r in collapsed(docs([(1, text), (2, long)]))}
    assert got[1][1:] == (400_001, [(0, 400_000, 1)], "w end")
    assert got[2][2] == [(0, 300_000, 70_000)] and got[2][3] == " ".join(map(str, range(70_000)))


def test_query_against_restatement(spark):
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words = plain_words(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        text = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(found), *first, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()))
    got = sorted(tuple(r) for r in queries.periodic_runs(spark, folder).collect())
    assert got == sorted(want) and sum(r[1] > 0 for r in got) > 10
