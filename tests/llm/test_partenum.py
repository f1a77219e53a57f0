import random
import re

import numpy as np
import pytest

from strandline.llm import partenum
from strandline.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, percent, width):
    """(doc_id, n, least reachable) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, s in sets.items():
        for b in {j for x in s for j in by[x] if j > a}:
            both = len(s & sets[b])
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def got(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(partenum.near_duplicates(docs, 85, 4)) == brute(rows, 85, 4)


def test_near_copies_of_all_sizes(spark):
    rnd, rows = random.Random(5), []
    vocab = [f"w{i}" for i in range(3000)]
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 18, 22, 30, 45, 70, 120, 250, 600]:
        base = [rnd.choice(vocab) for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 20))):
                at = rnd.randrange(len(copy) + 1)
                copy[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
            rows.append((len(rows), rnd.choice([" ", "\n", " \t "]).join(copy).upper() if rnd.random() < 0.3 else " ".join(copy)))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(partenum.near_duplicates(docs, 85, 4)) == brute(rows, 85, 4)
    assert got(partenum.near_duplicates(docs)) == brute(rows, 80, 5)
    assert got(partenum.near_duplicates(docs, 85, 4, n2=4, k2=2)) == brute(rows, 85, 4)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK_SETS", 5)
    monkeypatch.setattr(partenum, "BLOCK_SKETCHES", 3)
    rnd = random.Random(7)
    chain = [[f"c{i}" for i in range(100)]]
    for i in range(60):  # each linked with the one before only
        chain.append([w if j != i % 100 else f"x{i}" for j, w in enumerate(chain[-1])])
    rows = list(enumerate(" ".join(c) for c in chain))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[2] for r in got(partenum.near_duplicates(docs, 85, 4))} == {0}
    assert got(partenum.near_duplicates(docs, 85, 4)) == brute(rows, 85, 4)


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(3, None), (1, ""), (2, " \n"), (5, "a b"), (4, "A b"), (4, "A b"), (None, "a b"), (9, "a"), (8, long), (7, long + " end")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, set_id int, a string")
    out = {(r[0], r[1], r[2]) for r in (tuple(r) for r in partenum.near_duplicates(docs, 85, 4).collect())}
    assert out == {(3, 0, 3), (1, 0, 1), (2, 0, 2), (5, 1, 4), (4, 1, 4), (None, 1, None), (9, 1, 9), (8, 29997, 7), (7, 29998, 7)}
    assert partenum.near_duplicates(docs, 85, 4).count() == 10
    assert partenum.near_duplicates(docs.where("false")).count() == 0


def test_sketches_of_long_texts(spark):
    """Sets around the sizes where sketches get more cells: links across them stay, other pairs do not come through."""
    rnd = np.random.default_rng(3)
    sets = []
    for size in (900, 1024, 1030, 2040, 2060, 5000, 9000):
        base = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
        sets += [base, base[: int(size * 0.82)], np.concatenate([base, np.unique(rnd.integers(0, 1 << 63, size // 10).astype(np.uint64))])]
    assert {len(partenum.sketch(s)) for s in sets} >= {128, 256, 512, 1024, 2048}
    all_of = partenum.Sketches([partenum.sketch(partenum.T.mix(s)).tobytes() for s in sets])
    for a in range(len(sets)):
        near = all_of.distances(a, np.arange(len(sets)))
        for b in range(len(sets)):
            apart = len(np.setxor1d(sets[a], sets[b]))
            assert near[b] <= apart
            if a // 3 != b // 3 and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])):
                assert 180 * near[b] > 20 * (len(sets[a]) + len(sets[b]))
    words = [" ".join(f"v{i}" for i in rnd.integers(0, 100_000, n)) for n in (1020, 1028, 2050, 4100)]
    rows = [(2 * i, t) for i, t in enumerate(words)] + [(2 * i + 1, t + " " + t[: len(t) // 10]) for i, t in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(partenum.near_duplicates(docs)) == brute(rows, 80, 5)


def test_forest_is_exact():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 40, 100)
    sets = [np.unique(np.concatenate([base[rnd.random(100) < p], rnd.integers(0, 1 << 40, 5)])) for p in rnd.choice([0.5, 0.95], 60)]
    root = list(range(60))

    def find(r, i):
        while r[i] != i:
            i = r[i]
        return i

    for a in range(60):
        for b in range(a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                root[find(root, a)] = find(root, b)
    mine = list(range(60))
    for a, b in partenum.linked_forest(np.arange(60), sets, 85):
        mine[find(mine, a)] = find(mine, b)
    groups = lambda r: {frozenset(j for j in range(60) if find(r, j) == find(r, i)) for i in range(60)}
    assert groups(root) == groups(mine)


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1)], [(i, i + 1) for i in range(50)], []])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    out = {r.node: r.root for r in components(frame).collect()}
    if len(edges) == 50:
        assert out == dict.fromkeys(range(51), 0)
    elif edges:
        assert out == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    else:
        assert out == {}
