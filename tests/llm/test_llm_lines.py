import hashlib
import random

import numpy as np

from spanloom.llm import lines
from spanloom.llm.lines import CuckooFilter

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_chars, min_docs):
    def key(line):
        k = line.strip(lines.BLANKS).translate(LOWER)
        return k if len(k) >= min_chars else None

    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if (k := key(line)) is not None:
                held.setdefault(k, set()).add(i)
    last = {k: max(i, key=lambda x: (x is not None, x or 0)) if None in i else max(i) for k, i in held.items() if len(i) >= min_docs}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [line for line in every if (k := key(line)) not in last or last[k] == i]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in lines.line_dedup(df, **options).select("_doc.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def sample(seed, n):
    rnd = random.Random(seed)
    pool = ["Alpha beta", " alpha BETA\t", "gamma", "ÄÖ delta x", "", "epsilon zeta", "ab"]
    return [(i, rnd.choice([None, "", "\n"]) if rnd.random() < 0.1 else "\n".join(rnd.choice([*pool, f"line {i}"]) for _ in range(rnd.randrange(1, 6)))) for i in range(n)]


def test_lines_against_restatement(docs):
    rows = [*sample(3, 60), (7, "gamma\ngamma"), (7, "gamma\ngamma"), (None, "gamma\nepsilon zeta")]
    for filter_bytes in (1 << 20, 0):  # with the filters, and beyond their bound
        assert run(docs(rows), min_chars=4, min_docs=3, filter_bytes=filter_bytes) == plain(rows, 4, 3)
    assert run(docs([])) == []


def test_deletion_reverses_insertion(docs):
    old, new = sample(4, 30), [(100 + i, t) for i, t in sample(5, 30)]
    before = lines.insert_documents(None, docs(old), 4)
    both = lines.insert_documents(before, docs(new), 4)
    after = lines.delete_documents(both, docs(new), 4)
    table = lambda df: sorted((bytes(r.key), r.doc_id, r.n) for r in df.collect())
    assert table(after) == table(before)
    assert table(lines.delete_documents(both, docs([*old, *new]), 4)) == []
    assert run(docs(old), held=after, min_chars=4, min_docs=3) == plain(old, 4, 3)


def test_cuckoo_filter():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    made = CuckooFilter.unpack(CuckooFilter.of(keys).pack())
    assert made.holds(keys).all()
    assert made.holds(rng.integers(0, 1 << 63, (20000, 2), dtype=np.uint64)).mean() < 0.01
    marks, first = CuckooFilter.split(keys)
    for bucket, mark in zip(first[:2500].tolist(), marks[:2500].tolist()):
        assert made.delete(bucket, mark)
    assert made.holds(keys[2500:]).all() and made.holds(keys[:2500]).mean() < 0.01
    full = CuckooFilter(4)
    for bucket, mark in zip(first[:200].tolist(), marks[:200].tolist()):
        full.insert(bucket, mark)
    assert full.holds(keys[:200]).all()  # marks without a place are kept aside


def test_filter_follows_changes():
    rng = np.random.default_rng(7)
    names = [rng.bytes(16) for _ in range(100)]
    packed = CuckooFilter.of(lines._wide(names[:60])).pack()
    packed = lines.changed_filter(packed, names[60:], names[:30])
    assert CuckooFilter.unpack(packed).holds(lines._wide(names[30:])).all()
