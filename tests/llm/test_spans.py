import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import spans


def brute(rows, width):
    first = {}
    raws = [(NO if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, raw in raws:
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w not in first or (key, p) < first[w]:
                first[w] = (key, p)
    out = []
    for key, i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] != (key, p):
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i if i is not None else -1, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


NO = spans.NO_ID


def got(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(spans.repeated_spans(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 100)


def mixture(n):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(20, 300)))
    parts = [word() for _ in range(12)] + ["a" * 400, "ab" * 150]
    rows = [(i, "".join(rnd.choice(parts)[rnd.randint(0, 30) :] + rnd.choice(["", word()]) for _ in range(rnd.randint(0, 5)))) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def test_random_mixtures(spark, monkeypatch):
    rows = mixture(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 100)
    assert got(spans.repeated_spans(docs.repartition(5))) == want
    assert got(spans.repeated_spans(docs, held=1000)) == want
    monkeypatch.setattr(spans, "PIECE", 256)  # long texts are cut
    assert got(spans.repeated_spans(docs.repartition(3))) == want
    kept = {r.doc_id: bytes(r.kept) for r in spans.deduplicated(docs).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == h for i, _, _, _, h in want)


def test_odd_rows(spark):
    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdefgh") for _ in range(500))
    rows = [(None, a), (1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101), (6, a[:300]), (7, "q" + a[1:]), (9, a[200:] + a[:200]), (8, a * 40)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, pos int")
    assert got(spans.repeated_spans(docs)) == brute(rows, 100)
    assert spans.repeated_spans(docs.where("false")).count() == 0
    twins = spark.createDataFrame([(1, a), (1, a), (2, a)], "doc_id long, text string")
    assert [r.n_removed for r in spans.repeated_spans(twins).orderBy("doc_id").collect()] == [0, 0, 500]
    same = spark.createDataFrame([(1, a), (2, a[::-1]), (2, a), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.kept)) for r in spans.deduplicated(same).collect()) == [(1, 500), (2, 0), (2, 500), (3, 0)]


@pytest.mark.parametrize("width", [24, 31, 150, 200, 600])
def test_other_widths(spark, width):
    rows = mixture(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(spans.repeated_spans(docs, width)) == brute(rows, width)


def test_widths_that_cannot_be(spark):
    with pytest.raises(ValueError):
        spans.repeated_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spans.GRAM - 1)


def test_common_anchors(spark, monkeypatch):
    """A line in most documents: its anchors are found, and dealt as names and windows they give the same rows."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line = word(140)
    rows = [(i, word(rnd.randint(0, 80)) + line + word(rnd.randint(0, 80)) + (line[:120] if i % 3 else "")) for i in range(300)] + [(i, word(500)) for i in range(300, 330)]
    rows += [(5, rows[5][1]), (None, line), (7, "x" * 300), (8, "x" * 260)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 100)
    for sampled, slots in ((1, 1 << 17), (1, 2), (16, 1 << 17)):
        monkeypatch.setattr(spans, "SAMPLED", sampled)
        monkeypatch.setattr(spans, "SLOTS", slots)
        given = docs.select(F.coalesce("doc_id", F.lit(0)).alias("key"), "text")
        assert len(spans.common_anchors(given, 100)) > 0 or sampled > 1
        assert got(spans.repeated_spans(docs)) == want
