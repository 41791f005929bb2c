import random

import corpus_pipeline as cp
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanloom.llm import shingles
from spanloom.llm.common import settled

FOLDER = "/root/testdata/sf0.01"


def plain_set(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(rows):
    """Smallest doc_id (null last) that can be reached, by all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in found if d is not None), default=None) for r, found in names.items()}
    return [(doc, least[find(i)]) for i, (doc, _) in enumerate(rows)]


def near_copies(seed, bases=30):
    """Texts with copies of 1 to 8 changed words in 60 to 120: similarities on both sides of 0.8."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    passage = rnd.choices(vocabulary, k=25)  # in every third text
    rows = []
    for base in range(bases):
        words = rnd.choices(vocabulary, k=rnd.randrange(60, 120)) + (passage if base % 3 == 0 else [])
        for _ in range(rnd.randrange(1, 6)):
            copy = list(words)
            for _ in range(rnd.randrange(0, 9)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (None, rows[0][1]), (903, "one two")]
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = near_copies(5)
    df = settled(spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "_row bigint, doc_id bigint, text string"), "texts")
    want = sorted(plain_groups(rows), key=str)
    for first in (4, 0):  # with the first round, and by the second alone
        got = shingles.shingle_groups(df, first=first).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert shingles.shingle_groups(df.filter("false")).collect() == []


def test_order_of_common_shingles_changes_no_prefix_guarantee():
    rnd = random.Random(6)
    texts = [t for _, t in near_copies(7, 12)]
    sets = [shingles.shingle_set(t or "") for t in texts]
    every = sorted({int(g) for s in sets for g in s})
    for share in (0, 0.1, 1):
        common = shingles.np.array(sorted(rnd.sample(every, int(share * len(every)))), dtype="int64")
        heads = [set(shingles.prefix(s, common).tolist()) for s in sets]
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i]) and near(set(sets[i].tolist()), set(sets[j].tolist())):
                    assert len(heads[i] & heads[j]) > min(len(sets[i]), len(sets[j])) // shingles.PART


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    single = settled(dict(cp.STAGES)["near_duplicates"](spark, docs, FOLDER), "single")
    assert single.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = sorted({least for _, least in plain_groups(rows)})
    assert sorted(r.doc_id for r in single.select(F.col("doc_id")).collect()) == want


def test_a_common_passage_makes_few_candidates(spark):
    """Documents that share twelve words of fifteen do not link; the shared ones are not paired."""
    rnd = random.Random(8)
    words = " ".join(f"c{i}" for i in range(12))
    rows = [(i, f"{words} {rnd.random()} {rnd.random()} {rnd.random()}") for i in range(1500)] + [(2000, f"{words} 1 2 3"), (2001, f"{words} 1 2 3 4")]
    sets = [shingles.shingle_set(t) for _, t in rows]
    common = shingles.np.sort(shingles.shingle_set(words))
    entries = [(int(g), i, len(s), p, i) for i, s in enumerate(sets) for p, g in enumerate(shingles.prefix(s, common))]
    found = shingles.candidates(spark.createDataFrame(entries, "_gram bigint, _node bigint, _n int, _pos int, _root bigint"), shingles.SHARE)
    assert {tuple(sorted(r)) for r in found.collect()} == {(1500, 1501)}
    df = settled(spark.createDataFrame([(i, i, t) for i, t in rows], "_row bigint, doc_id bigint, text string"), "texts")
    got = {r.doc_id: r.component_id for r in shingles.shingle_groups(df).collect()}
    assert got == {i: 2000 if i == 2001 else i for i, _ in rows}


def test_what_many_documents_share_is_common_in_tables_of_any_size(spark, monkeypatch):
    """Forty passages, each in 80 of 3,200 texts: a sample of 100 texts holds each of them two or three times."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    passages = [" ".join(word() for _ in range(5)) for _ in range(40)]
    rows = [(i, i, f"{' '.join(word() for _ in range(12))} {passages[i % 40]}") for i in range(3200)]
    docs = spark.createDataFrame(rows, "_row bigint, doc_id bigint, text string")
    monkeypatch.setattr(shingles, "COMMON_LEAST", 4)
    found = set(shingles.common_shingles(docs, 5, 100).tolist())
    wanted = {int(shingles.shingle_set(p)[0]) for p in passages}
    assert len(wanted & found) >= 36 and len(found) <= 200
