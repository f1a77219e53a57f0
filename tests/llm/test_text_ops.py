"""Toxicity, decontamination, languages, packing and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language, packing, partenum, tiling, toxicity

SF = "/root/testdata/sf0.01"


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lexicon_against_edit_distance():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(12)]
    lexicon = toxicity.compile_lexicon(words, ["bbba"])
    tokens = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(3000)] + words
    raw = [t.encode() for t in tokens]
    ends = np.cumsum([len(r) for r in raw])
    got = lexicon.match(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    for t, kind in zip(tokens, got.tolist()):
        want = 2 if t in words else 3 if t.startswith("bbba") else int(any(len(w) >= toxicity.FUZZY_FROM and within_one_edit(t, w) for w in words))
        assert kind == want, t


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.95 * got.count()
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (3, "x " * 50_000 + "you stupidd idiot", 3), (4, "stupid moron", 4)], "doc_id long, text string, score int")
    out = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert [out[i].predicted for i in (None, 1, 3, 4)] == [0, 0, 1, 1] and len(out[3].hits) == 2
    assert toxicity.score(odd.where("false"), model).count() == 0 and toxicity.learn(docs, labels.where("false")).score(np.zeros((1, 5)))[0] < 0.5
    names = ["predicted", "hits", "held_out", "_score", "k0", "k1", "text_"]
    clashing = odd.withColumns({x: F.lit(1) for x in names})
    kept = toxicity.clean(clashing, model)
    assert kept.columns == clashing.columns and sorted(r.score for r in kept.collect()) == [1, 2] and kept.select(*names).distinct().collect() == [(1,) * len(names)]
    assert toxicity.clean(odd.where("false"), model).count() == 0


def test_context_weighs():
    lexicon = toxicity.compile_lexicon(["idiot"], [])
    weight = lambda t: toxicity.features(lexicon, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1][0][3]
    assert weight('he said "an idiot" there') < weight("an idiot there") < weight("you idiot")


def test_tiling():
    rnd = random.Random(1)
    item = np.array([rnd.randrange(1 << 62) for _ in range(40)], np.uint64)
    text = np.concatenate([item[20:], [np.uint64(5)], item[:20]])
    assert sorted(tiling.tile(item, text)) == [(0, 21, 20), (20, 0, 20)]
    assert tiling.tile(item, item[:4]) == []


def test_contaminations(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, None), (4, "")], "item_id long, text string")
    moved = " ".join(["x"] * 50 + words[15:30] + ["y", "z"] + [w.upper() + "," for w in words[:15]])
    rows = [(1, moved), (2, " ".join(words[:10])), (3, None), (4, ""), (None, " ".join(words)), (5, "w1 " * 500), (1, moved)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = sorted(((r.doc_id or -1, r.item_id, r.coverage) for r in tiling.contaminations(docs, bench).collect()))
    assert got == [(-1, 1, 1.0), (-1, 2, 1.0), (1, 1, 1.0), (1, 1, 1.0)]
    assert sorted(r.doc_id for r in tiling.clean(docs, bench).collect()) == [2, 3, 4, 5]
    assert tiling.contaminations(docs, bench.where("false")).count() == 0 and tiling.contaminations(docs.where("false"), bench).count() == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    got = language.identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    en, de = (docs.where(f"lang = '{x}' and length(text) > 1500").orderBy("doc_id").head().text[:1000] for x in ("en", "de"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, en + " " + de), (None, en), (5, "é" * 50_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[None].lang_pred == "en"
    assert [s.lang for s in out[4].spans] == ["en", "de"] and language.identify(odd.where("false"), model).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_viterbi_against_all_paths():
    from itertools import product

    rnd = np.random.default_rng(3)
    scores, first = rnd.normal(size=(12, 3)) * 2, np.array([0, 5, 5, 6, 12])
    got = language.viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023,E731
        if b > a:
            assert value(got[a:b].tolist()) == pytest.approx(max(map(value, product(range(3), repeat=b - a))))


def test_best_fit():
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 50) for _ in range(500)]
    rows = packing.best_fit(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sum(sizes[i] for i in r) <= 64 for r in rows)
    room, plain = [], []
    for i in sorted(range(500), key=lambda i: -sizes[i]):
        fit = [r for r in range(len(room)) if room[r] >= sizes[i]]
        if fit:
            room[min(fit, key=lambda r: room[r])] -= sizes[i]
        else:
            room.append(64 - sizes[i])
        plain.append(i)
    assert len(rows) == len(room)


def test_packing_round_trip(spark):
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 20_000), (None, "x"), (5, "é𐀀")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    packed = packing.pack(docs, row=128, group=1000)
    assert {r.doc_id: r.ids for r in packing.unpack(packed).collect()} == {i: [*encode(t or ""), packing.END_ID] for i, t in rows}
    assert all(r.cu_seqlens[:-1] == r.position_resets and r.cu_seqlens[-1] == r.n_tokens and len(r.ids) == 256 for r in packed.collect())
    assert packing.pack(docs.where("false")).count() == 0


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            again = partenum.near_duplicates(docs)
            assert again.where("doc_id <> component_id").count() == 0 and 0 < docs.count() < before.count()
    assert docs.count() > 0
