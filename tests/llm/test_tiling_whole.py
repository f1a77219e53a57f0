"""Tiling goes on until no free match of the least length is left."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import tiling


def slow(item, text, least):
    """Covered tokens when the longest free match is marked again and again."""
    a, b, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        a[i : i + n], b[j : j + n], total = [False] * n, [False] * n, total + n


def test_free_part_of_a_cut_match():
    item = np.arange(20, dtype=np.uint64)
    text = np.concatenate([item[5:14], [np.uint64(99)], item[:8]])
    assert sorted(tiling.tile(item, text)) == [(0, 10, 5), (5, 0, 9)]


def test_against_repeated_longest_match():
    rnd = random.Random(8)
    for _ in range(150):
        item = np.array([rnd.randrange(rnd.choice([3, 30])) for _ in range(rnd.randint(5, 30))], np.uint64)
        parts = [item[a : a + rnd.randint(3, 12)] for a in (rnd.randrange(len(item)) for _ in range(4))]
        text = np.concatenate([x for p in parts for x in (p, [np.uint64(rnd.randrange(60))])])
        tiles = tiling.tile(item, text, 3)
        assert sum(n for _, _, n in tiles) == slow(item.tolist(), text.tolist(), 3)
        assert all((item[i : i + n] == text[j : j + n]).all() for i, j, n in tiles)


def test_quoted_in_overlapping_fragments(spark):
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join([*words[5:14], "x", *words[:8]]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [(r.covered, r.tiles) for r in tiling.contaminations(docs, bench).collect()] == [(14, 2)]
    assert tiling.clean(docs, bench).count() == 0


def brute(docs, items, cover=0.5):
    """Every item against every document, token by token."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = []
    for d, text in docs:
        for i, item in items:
            a = words(item)
            if a and (n := slow(a, words(text), min(len(a), tiling.SEED))) >= max(-(-len(a) * cover // 1), 1):
                out.append((-1 if d is None else d, i, len(a), n))
    return sorted(out)


def test_contaminations_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 3, 4, 5, 6, 9, 14, 25])))) for i in range(40)]
    items += [(90 + i, f"which of the following is {' '.join(rnd.choices(vocab, k=6))}") for i in range(10)] + [(100, "x " * 30)]
    docs = []
    for d in range(90):
        parts = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 12)))]
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(len(w))
            parts += [", ".join(w[a : a + rnd.randint(1, len(w))]).upper(), rnd.choice(vocab)]
        docs.append((d if d % 7 else None, " ".join(parts)))
    docs += [(200, "what is two plus"), (201, "x " * 500), (202, ""), (203, None)]
    items += [(200, "two plus"), (201, ""), (202, None)]
    frame = lambda rows, ident: spark.createDataFrame([(*r, "z") for r in rows], f"{ident} long, text string, item string")
    for cover in (0.5, 0.8):
        want = brute(docs, [x for x in items if x[1]], cover)
        for bits in (tiling.BITS, 15):  # a bitmap that lets much through changes nothing
            got = tiling.contaminations(frame(docs, "doc_id"), frame(items, "item_id"), cover, bits)
            assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.item_tokens, r.covered) for r in got.collect()) == want
    assert (200, 200, 2, 2) in want and (201, 100, 30, 30) in want


def test_clean_goes_by_text_and_keeps_columns(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    rows = [(1, "A b c d e f", 1, "p"), (1, "other words", 2, "q"), (None, "a b c d e f", 3, "r"), (None, None, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, _found string").withColumn("_gone", F.lit(1))
    for few in (tiling.FEW, -1):
        monkeypatch.setattr(tiling, "FEW", few)
        kept = tiling.clean(docs, bench)
        assert kept.columns == docs.columns and sorted(r["_row"] for r in kept.collect()) == [2, 4]
    assert tiling.clean(docs, bench.where("false")).count() == 4


def test_repeated_words_are_no_squares():
    one = np.full(1500, 7, np.uint64)
    began = time.perf_counter()
    assert sum(n for _, _, n in tiling.tile(one, np.full(6000, 7, np.uint64))) == 1500
    mixed = np.array(([1, 2, 3, 4, 5, 6] * 250)[:1500], np.uint64)
    assert sum(n for _, _, n in tiling.tile(mixed, np.tile(np.arange(1, 7, dtype=np.uint64), 1000))) == 1500
    assert time.perf_counter() - began < 3
