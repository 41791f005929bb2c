import hashlib
import random
import re

from spanloom.llm.exact import exact_dedup


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i is None, i) for i in ids)[1]
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in exact_dedup(df, **options).collect()), key=str)


def test_names_agree_with_texts(docs):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9)))) for i in range(150)]
    rows += [(500 + i, "abcd" * rnd.randrange(0, 9) + rnd.choice(["", "x"])) for i in range(150)]
    assert run(docs(rows), block_chars=2) == plain(rows)


def test_edges(docs):
    rows = [(3, None), (1, ""), (2, " "), (5, "a \t b"), (4, "a b"), (4, "a b"), (None, "a\nb"), (7, "é" * 3), (8, "é" * 3 + " ")]
    assert run(docs(rows), block_chars=2) == plain(rows)
    assert run(docs([])) == []


def test_hot_text_and_order_of_rows(docs):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(400)]
    assert run(docs(rows), block_chars=4) == plain(rows)
    assert run(docs(rows[::-1])) == plain(rows)
