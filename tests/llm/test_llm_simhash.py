import random

import numpy as np
import xxhash

from spanloom.llm import simhash


def plain_print(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, bits=4):
    """Smallest position reachable from each."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_of_texts():
    rnd = random.Random(8)
    for n in (0, 1, 3, 4, 5, 40, 400):
        text = " ".join("".join(rnd.choice("abÄß") for _ in range(3)) for _ in range(n)) + rnd.choice(["", "\n", "\t\r x"])
        assert simhash.simhash(text) == plain_print(text)


def clusters(seed, n):
    rnd = random.Random(seed)
    centers = [rnd.getrandbits(64) for _ in range(6)]
    values = {0}
    while len(values) < n:
        v = rnd.choice([*centers, rnd.getrandbits(64)])
        for _ in range(rnd.randrange(0, 5)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    return sorted(values)


def test_links_connect_what_all_pairs_connect(spark):
    values = clusters(9, 400)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "_print bigint")
    want = plain_roots(values)
    for tile in (4096, 8):  # short entries, and entries cut into tiles
        found = {r.node: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()}
        groups = {}
        for v, w in zip(values, want):
            s = simhash._signed(v)
            groups.setdefault(w, set()).add(found.get(s, s))
        assert all(len(g) == 1 for g in groups.values()), tile
        assert len(set.union(*groups.values())) == len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[i] == 100 for i in range(101, 160))
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_groups(docs):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, t.upper()) for i, t in enumerate(texts[:4])]
    rows += [(80 + i, t + " zzz") for i, t in enumerate(texts[:6])] + [(90, None), (91, ""), (92, " \n"), (92, " \n"), (93, "x"), (None, texts[0])]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs(rows)).collect()), key=str)
    prints = [plain_print(t) for _, t in rows]
    roots = plain_roots(prints)
    name = {}
    for (i, _), r in zip(rows, roots):
        name[r] = i if name.get(r) is None else name[r] if i is None else min(name[r], i)
    assert got == sorted(((i, f"{p:016x}", name[r]) for (i, _), p, r in zip(rows, prints, roots)), key=str)
    assert simhash.simhash_groups(docs([])).collect() == []


def test_forest_links_only_near_values():
    values = np.array(clusters(11, 60), dtype=np.uint64).view(np.int64)
    for a, b in simhash.links_within(values, None, 4):
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
