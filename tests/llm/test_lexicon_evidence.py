"""The toxicity lexicon: entries, edits and context by evidence; features against a plain version."""

import math
import random
import re

import numpy as np

from strandline.llm import toxicity


def word(rnd, n):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_varied_terms_enter():
    rnd = random.Random(5)
    usual, terms = [word(rnd, 6) for _ in range(800)], [word(rnd, 8) for _ in range(80)]
    text = lambda *more: " ".join([*rnd.choices(usual, k=40), *more])
    rows = [(text(*(terms[(i + 20 * j) % 80] for j in range(4))), 1) for i in range(400)] + [(text(), 0) for _ in range(2_000)]
    words, _ = toxicity.choose_entries(rows)  # each term stands in 5 % of the toxic texts
    assert set(words) == set(terms)
    model = toxicity.fit(rows)
    for term in terms:
        raw = np.frombuffer(f"{text()} {term}".encode(), np.uint8)
        assert model.score(toxicity.features(model.lexicon, raw, np.array([0, len(raw)]), model.stem_rate)[0])[0] > 0.5


def test_copies_are_evidence_once():
    rnd = random.Random(6)
    usual = [word(rnd, 6) for _ in range(800)]
    once = " ".join(word(rnd, 8) for _ in range(40))
    rows = [(" ".join(rnd.choices(usual, k=40)), int(i < 300)) for i in range(2_000)] + [(once, 1)] * 12
    assert not set(toxicity.choose_entries(rows)[0]) & set(once.split())


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_features_against_a_plain_version():
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    words, stems = [letters(rnd.randint(3, 7)) for _ in range(8)], ["bbba"]
    fuzzy, harmless = set(words[::2]), {letters(5) for _ in range(40)} - set(words)
    lexicon = toxicity.compile_lexicon(words, stems, fuzzy, harmless)
    glue = [" ", ", ", ' "', '" ', " «", "» ", " you ", " said ", "\n"]
    texts = ["".join(letters(rnd.randint(1, 8)) + rnd.choice(glue) for _ in range(rnd.randint(0, 40))) for _ in range(150)] + ["", "é" * 30]
    raw = [t.encode() for t in texts]
    x, hits = toxicity.features(lexicon, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 0.01, (0.5, 0.25, 3.0))
    want = []
    for d, t in enumerate(texts):
        tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[a-zA-Z0-9\x80-\U0010ffff]+", t)]
        tokens = [(len(t[:a].encode()), len(t[:b].encode()), w) for a, b, w in tokens]
        for i, (a, b, w) in enumerate(tokens):
            w = w.lower()
            kind = 2 if w in words else 3 if w.startswith("bbba") else 0 if w in harmless else 1 if any(near(w.encode(), e.encode()) for e in fuzzy) else 4 if any(len(e) >= 5 and near(w.encode(), e.encode()) for e in words) else 0
            if kind:
                part = tokens[max(i - 6, 0) : i + 7]
                r = t.encode()
                before, after = r[part[0][0] : a].decode(), r[b : part[-1][1]].decode()
                around = {v.lower() for s, _, v in part if s != a}
                weight = (0.5 if set(before) & toxicity.QUOTES and set(after) & toxicity.QUOTES else 1) * (0.25 if around & toxicity.SAYING else 1) * (3.0 if around & toxicity.SECOND_PERSON else 1)
                want.append((d, a, b, weight * (kind < 4), kind))
    assert hits == want and {h[4] for h in want} == {1, 2, 3, 4}
    for d in range(len(texts)):
        mine = [h for h in want if h[0] == d]
        for kind, column in ((2, 0), (1, 1)):
            total = sum(h[3] for h in mine if h[4] == kind)
            assert math.isclose(x[d, column], math.log1p(total)) and x[d, column + 2] == (total > 0)
    assert toxicity.features(lexicon, np.zeros(0, np.uint8), np.array([0, 0]))[0].tolist() == [[0.0] * 5]


def test_edits_are_learned():
    """A misspelled term is caught where clean texts lack such words, and harmless words stay harmless."""
    rnd = random.Random(3)
    usual, terms = [word(rnd, 6) for _ in range(600)], [word(rnd, 7) for _ in range(6)]
    twin = [w[:3] + w[4:] for w in terms[:2]]  # usual words one edit from a term
    text = lambda *more: " ".join([*rnd.choices(usual + twin, k=40), *more])
    rows = [(text(*rnd.choices(terms, k=3)), 1) for _ in range(300)] + [(text(), 0) for _ in range(1_500)]
    model = toxicity.fit(rows)
    score = lambda t: model.score(toxicity.features(model.lexicon, (r := np.frombuffer(t.encode(), np.uint8)), np.array([0, len(r)]), model.stem_rate, model.factors)[0])[0]
    assert model.weights[4] > 0
    misspelled = [w[:i] + "q" + w[i + 1 :] for w in terms for i in (1, 5)]
    assert all(score(f"{text()} {w}") > 0.5 for w in misspelled + terms)
    assert all(score(f"{text()} {w}") < 0.5 for w in twin) and sum(score(text()) > 0.5 for _ in range(200)) == 0


def test_quotation_is_learned():
    """Where quoted terms are not toxic, the factor of quotation marks falls below its usual value."""
    rnd = random.Random(4)
    usual, terms = [word(rnd, 6) for _ in range(600)], [word(rnd, 7) for _ in range(4)]
    text = lambda more="": " ".join([*rnd.choices(usual, k=20), more, *rnd.choices(usual, k=20)])
    toxic = [(text(rnd.choice(terms)), 1) for _ in range(400)]
    clean = [(text(), 0) for _ in range(2_500)] + [(text(f'"{rnd.choice(usual)} {rnd.choice(terms)} {rnd.choice(usual)}"'), 0) for _ in range(4)]
    assert toxicity.fit(toxic + clean).factors[0] < toxicity.FACTORS[0]


def test_stems_of_any_length():
    shared = toxicity._shared_prefixes({"abcdefghijkla", "abcdefghijklb", "abcdefghijklc", "abcdefghijkld", "abcx"}, 4)
    assert shared["abcdefghijkla"][-1] == "abcdefghijkl" and "abcx" not in shared
