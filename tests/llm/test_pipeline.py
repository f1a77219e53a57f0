"""Each stage of the pipeline against a plain version, on given rows, odd rows and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import packing, toxicity
from test_partenum import shingles
from test_tiling_whole import slow

SF = "/root/testdata/sf0.001"
ODD = ["_kept", "_found", "_gone", "_row", "_name", "predicted", "score", "hits", "held_out", "target", "_rank", "size", "_size", "copies", "col", "k0", "mark", "set_id", "component_id", "shard", "print", "row", "u", "n"]


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


@pytest.fixture(scope="module")
def docs(spark, stages):
    rnd = random.Random(2)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head().text
    base = " ".join(f"b{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(9001, base, "en", "s"), (9001, other, "en", "s"), (9001, other + " end", "en", "t"), (9002, base, None, None), (9002, base, None, None), (9003, None, None, None), (9003, "", None, "s"), (9004, " \n", "x", "s"), (None, base, "x", "s"), (None, None, None, None), (9005, "long words " * 3_000 + item, "en", "s"), (9006, "you stupid pathetic idiot, you are a worthless loser", "en", "s"), (9007, " ".join(rnd.sample(base.split(), 60)), "en", "s")]
    more = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return given.unionByName(more).withColumns({c: F.lit(7) for c in ODD}).cache()


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in frame.collect()), key=repr)


def checked(before, after):
    assert after.columns == before.columns
    assert after.select(*ODD).distinct().collect() in ([], [(7,) * len(ODD)])
    return rows_of(after)


def test_toxicity(spark, stages, docs):
    got = checked(docs, stages["toxicity"](spark, docs, SF))
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return model.score(toxicity.features(model.lexicon, raw, np.array([0, len(raw)]), model.stem_rate, model.factors)[0])[0]

    assert got == [r for r in rows_of(docs) if score(r[1]) < 0.5]
    assert 9006 not in {r[0] for r in got} and stages["toxicity"](spark, docs.where("false"), SF).count() == 0


def test_near_duplicates(spark, stages, docs):
    got = checked(docs, stages["near_duplicates"](spark, docs, SF))
    rows = rows_of(docs)
    known = sorted({(i, t) for i, t, _, _ in rows if i is not None}, key=repr)
    sets = [shingles(t, 5) for _, t in known]
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(known)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                root[find(a)] = find(b)
    classes = {}
    for k in range(len(known)):
        classes.setdefault(find(k) if sets[k] else -k - 1, []).append(k)
    assert len([r for r in got if r[0] is not None]) == len(classes) and len([r for r in got if r[0] is None]) == len([r for r in rows if r[0] is None])
    kept = {(i, t) for i, t, _, _ in got if i is not None}
    for members in classes.values():
        mine = [known[k] for k in members if known[k] in kept]
        assert len(mine) == 1 and mine[0][0] == min(known[k][0] for k in members)
    assert {t[:2] for i, t in kept if i == 9001} == {"b0", "o0"} and stages["near_duplicates"](spark, docs.where("false"), SF).count() == 0


def test_decontamination(spark, stages, docs):
    small = docs.where("doc_id is null or length(text) < 3000 or text is null or doc_id = 9005")
    got = checked(docs, stages["decontamination"](spark, small, SF))
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r.text))]

    def contains(text):
        t = words(text)
        grams = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for a in items:
            if sum(tuple(a[i : i + 5]) in grams for i in range(len(a) - 4)) * 5 >= len(a) / 2:
                near = sorted({j for i in range(len(t) - 4) if any(tuple(t[i : i + 5]) == tuple(a[k : k + 5]) for k in range(len(a) - 4)) for j in range(i, i + 6)} & set(range(len(t))))
                if slow(a, [t[j] for j in near], 5) >= math.ceil(len(a) / 2):
                    return True
        return False

    assert got == [r for r in rows_of(small) if not contains(r[1])]
    assert 9005 not in {r[0] for r in got} and stages["decontamination"](spark, docs.where("false"), SF).count() == 0


def test_mixing(spark, stages, docs):
    got = checked(docs, stages["mixing"](spark, docs, SF))
    md5 = lambda b: hashlib.md5(b).hexdigest()
    mark = lambda i, t: int(md5(f"{'null' if i is None else i}#{'null' if t is None else md5(t.encode())}".encode())[:15], 16)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = rows_of(docs)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    full, left = set(), 1.5 * sum(total.values())
    while True:
        level = (left - sum(2 * total[s] for s in full)) / max(sum(weight[s] for s in sources if s not in full), 1)
        over = {s for s in sources if s not in full and level * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    want = []
    for k, s in enumerate(sources, 1):
        target = 2 * total[s] if s in full else level * weight[s]
        r = target / total[s] if total[s] else 0
        u = int(md5(f"{k}#17".encode())[:15], 16) % (1 << 20) / (1 << 20)
        order = sorted((x for x in rows if x[3] == s), key=lambda x: (len(str(size(x[1]))) * 100 + int(str(size(x[1]))[:2]), mark(x[0], x[1])))
        for n, x in enumerate(order, 1):
            want += [x] * (math.floor(r * n + u) - math.floor(r * (n - 1) + u))
    key = lambda rows: sorted((r[0], r[1], r[3]) for r in rows if r[0] is not None and r[1] is not None and r[3] is not None)
    assert len(got) == len(want) and key(got) == key(want) and stages["mixing"](spark, docs.where("false"), SF).count() == 0


def test_packing(spark, stages, docs):
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    got = stages["packing"](spark, once, SF).cache()
    want = {r.doc_id: [*encode(r.text or ""), packing.END_ID] for r in once.collect()}
    assert {r.doc_id: r.ids for r in packing.unpack(got).collect()} == want
    for shard in got.select("shard").distinct().collect():
        rows = got.where(F.col("shard") == shard.shard).collect()
        pieces = sorted((b - a for r in rows for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])), reverse=True)
        room = []
        for p in pieces:  # best fit, row by row
            fit = [i for i in range(len(room)) if room[i] >= p]
            if fit:
                room[min(fit, key=lambda i: room[i])] -= p
            else:
                room.append(packing.ROW - p)
        assert sorted(packing.ROW - r.n_tokens for r in rows) == sorted(room)
    assert stages["packing"](spark, docs.where("false"), SF).count() == 0
