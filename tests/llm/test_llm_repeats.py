import hashlib
import random

from spanloom.llm.repeats import remove_repeats, repeated_starts, trimmed
from spanloom.llm.suffixes import suffix_array


def plain(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        i, text = rows[k]
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r)[:5] for r in remove_repeats(df, **options).collect()), key=str)


def test_suffix_array_by_grouping():
    rnd = random.Random(14)
    for _ in range(500):
        data = bytes(rnd.randrange(256 if rnd.random() < 0.3 else 3) for _ in range(rnd.randrange(0, 60)))
        assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])
    for data in (b"a" * 300, b"ab" * 200, b"\x00" * 50 + b"\xff" * 50):
        assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


def test_starts_in_contexts():
    contexts = [((1, 0, 0), b"abcdefgh"), ((0, 5, 3), b"xbcdefgy"), ((2, 0, 0), b"efghijkl")]
    assert sorted(repeated_starts(contexts, 4)) == [(0, 1), (0, 2), (0, 3), (2, 0)]


def test_contexts_are_cut_to_what_they_share():
    contexts = [((0, 0, 10), b"abcdGRAMefgh"), ((1, 0, 20), b"xxcdGRAMefyy"), ((2, 0, 30), b"zzzzGRAMwwww")]
    assert trimmed(contexts, b"GRAM", 8) == [((0, 0, 12), b"cdGRAMef"), ((1, 0, 22), b"cdGRAMef")]
    assert trimmed(contexts, b"GRAM", 9) == []


def sample(seed, n, letters="ab"):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdé") for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [rnd.choice([*passages, "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 12)))]) for _ in range(rnd.randrange(0, 6))]
        text = "".join(parts)
        a, b = sorted(rnd.randrange(0, len(text) + 1) for _ in range(2))
        rows.append((i, rnd.choice([text, text, text[a:b]])))
    rnd.shuffle(rows)
    return rows


def test_against_restatement(docs):
    for seed, letters in ((15, "ab"), (16, "abcdefgh")):
        rows = sample(seed, 50, letters)
        want = plain(rows, 12)
        assert run(docs(rows), length=12, gram=4) == want
        assert run(docs(rows), length=12, gram=4, hot_contexts=1, sort_bytes=1) == want  # every group by its strings


def test_edges(spark, docs):
    # One task reads the rows in their order, which decides between rows of one doc_id.
    rows = [(3, None), (1, ""), (2, "short"), (4, "x" * 400), (6, "same passage " * 3), (6, "same passage " * 3), (None, "same passage " * 3), (5, "é" * 60)]
    assert run(docs(rows).coalesce(1), length=20, gram=6) == plain(rows, 20)
    assert run(docs([])) == []
    kept = {r.doc_id: r.kept for r in remove_repeats(docs([(1, "p" * 5 + "a passage of text"), (2, "a passage of text!")]), 10, 4, texts_too=True).collect()}
    assert kept[1] is None and bytes(kept[2]) == b"!"


def test_short_texts_do_not_change_hashes():
    import numpy as np

    from spanloom.llm import repeats

    hashers = [repeats.Hasher(base, 256) for base in (repeats.ODD, repeats.ODD_2)]
    short, long = (repeats.anchors(np.frombuffer(t, dtype=np.uint8), *hashers) for t in (b"short", bytes(range(200))))
    assert [np.concatenate(pair).dtype for pair in zip(short, long)] == [np.uint64, np.uint64, np.int64, np.int64]


def test_contexts_that_are_equal_when_cut_are_not_sorted(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from spanloom.llm import repeats

    monkeypatch.setattr(repeats, "repeated_starts", None)
    texts = [b"abcdGRAMefgh", b"xxcdGRAMefyy", b"wwcdGRAMefww"]
    grams = repeats.Hasher(repeats.ODD, 64)
    here, there = np.array([4]), np.array([8])
    gram = int(grams.of(grams.sums(np.frombuffer(texts[0], dtype=np.uint8)), here, there).view(np.int64)[0])
    rows = [pa.array([gram] * 3), pa.array([3, 1, 2]), pa.array([30, 10, 20]), pa.array([0, 5, 7], pa.int32()), pa.array(texts)]
    found = list(repeats._sorted_groups(8, 4, 1)(iter([pa.RecordBatch.from_arrays(rows, names=["_gram", "_doc", "_row", "_low", "_bytes"])])))
    assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == [(20, 9, 9), (30, 2, 2)]


def test_small_tables_are_joined_like_large_ones(docs):
    plan = remove_repeats(docs([(1, "a passage " * 20), (2, "a passage " * 20)]))
    plan.collect()
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
