"""Toxicity from a learned lexicon, matched with misspellings and weighed by context.

Learning: words, and word stems, that occur almost only in texts labelled toxic become the lexicon. Its trie is walked
together with the Levenshtein automaton of one edit; the reachable pairs (trie node, edits so far) are made deterministic
over byte classes, once on the driver; an edit is of one byte of UTF-8. A table row then stands for all entries that a word so far may still become.

A word within one edit of an entry may be a misspelling or a word of its own. Those that clean texts of the sample have are
words of their own: they are compiled into the automaton and accepted as harmless. An edit of an entry counts only if it tells: clean
texts that were kept apart when these words were gathered must have other words that near much more seldom than toxic texts
have the entry; other edits are reported, but weigh nothing. What an edit is worth is reckoned on such texts too.

Scoring: all tokens of a slice step through the table together and drop out once no entry is in reach, mostly after a few
bytes. Around each hit, a window tells quotation (quotation marks, words of saying) from abuse (second person); hits count
less or more by factors that are fitted to the sample, from usual values. A logistic model of the weighed hits gives the score.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import learning
from strandline.llm import textbuf as T
from strandline.sources.shared import importable

#: Labelled texts that are learned from, at most.
SAMPLE = 4_000
#: Tokens to each side of a hit that make its context.
WINDOW = 6
#: Where nothing is learned about that, entries of fewer bytes must be spelled exactly.
FUZZY_FROM = 5
#: The share of an entry's toxic texts that is taken to have it misspelled, and the odds (as a logarithm) by which these must
#: exceed clean texts with a strange word that near, for an edit to tell.
MISSPELLED, TELLING = 0.1, 3.0
#: Usual factors of a hit between quotation marks, near a word of saying, and near a second person.
FACTORS = (0.6, 0.7, 1.5)
LEAST_STEM = 4
SAYING = frozenset("said says quote quoted quotes wrote writes called reported claims claimed sagte sagt schrieb zitat dijo dice escribió cita dit écrit citation".split())
SECOND_PERSON = frozenset("you your youre yourself du dich dir dein euch ihr tu te tus usted vos vous toi votre".split())
QUOTES = frozenset('"“”„«»')


@dataclass
class Lexicon:
    table: np.ndarray  # (state, byte class) -> state; 0 is dead
    classes: np.ndarray  # byte -> class
    accepts: np.ndarray  # 0 none or a harmless word, 1 a word with a telling edit, 2 a word, 3 a stem, 4 a word with another edit
    start: int = 1

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """accepts of each token, in lower case."""
        kinds = self.classes[T.LOWER[data]]
        state = np.full(len(start), self.start, np.int32)
        size, live, t = end - start, np.arange(len(start)), 0
        while len(live):
            state[live] = self.table[state[live], kinds[start[live] + t]]
            t += 1
            live = live[(state[live] > 0) & (size[live] > t)]
        return self.accepts[state]


def compile_lexicon(words: list[str], stems: list[str], telling: set[str] | None = None, harmless: set[str] | frozenset = frozenset()) -> Lexicon:
    """The deterministic product of the trie and the one-edit automaton. A stem is met by any word that begins with it.

    Words of FUZZY_FROM bytes or more and those in ``telling`` are met with an edit too, but not by ``harmless`` words; the edit
    counts if the word is in ``telling`` (default: all that are met so).
    """
    edits_of = lambda w: 0 if len(w.encode()) < FUZZY_FROM and w not in (telling or ()) else 1 + (telling is None or w in telling)
    entries = [(w.encode(), 0, edits_of(w)) for w in words] + [(s.encode(), 1, 0) for s in stems] + [(w.encode(), 2, 0) for w in sorted(harmless)]
    trie: list[dict[int, int]] = [{}]
    whole, stem, safe, fuzzy, loose, told = set(), set(), set(), set(), set(), set()
    for raw, kind, edits in entries:
        at, path = 0, [0]
        for b in raw:
            if b not in trie[at]:
                trie[at][b] = len(trie)
                trie.append({})
            at = trie[at][b]
            path.append(at)
        (whole, stem, safe)[kind].add(at)
        if edits:
            fuzzy.update(path)
            (loose, told)[edits - 1].add(at)
    letters = sorted({b for node in trie for b in node})
    classes = np.zeros(256, np.int64)
    for i, b in enumerate(letters, 1):
        classes[b] = i

    def close(pairs: set[tuple[int, int]]) -> frozenset:
        """With a letter of the entry left out at the cost of an edit; no more than one edit."""
        out = set(pairs)
        for node, edits in pairs:
            if edits == 0 and node in fuzzy:
                out |= {(child, 1) for child in trie[node].values() if child in fuzzy}
        return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

    def step(pairs: frozenset, letter: int | None) -> frozenset:
        out = set()
        for node, edits in pairs:
            child = trie[node].get(letter)
            if child is not None and (edits == 0 or child in fuzzy):
                out.add((child, edits))
            if edits == 0 and node in fuzzy:
                out.add((node, 1))  # a letter too many
                out |= {(c, 1) for c in trie[node].values() if c in fuzzy}  # another letter
        return close(out)

    done = frozenset([(-1, 0)])  # past a stem: any rest is fine
    first = close({(0, 0)})
    states: dict[frozenset, int] = {frozenset(): 0, first: 1}
    order = [frozenset(), first]
    rows = []
    for pairs in order:
        past = pairs == done or any(n in stem and e == 0 for n, e in pairs)
        onward = set() if past else {b for node, _ in pairs for b in trie[node]}  # all other letters lead to one state
        row = []
        for letter in [None, *letters]:
            if not pairs or (letter is not None and letter not in onward):
                row.append(row[0] if row else 0)
                continue
            after = done if past else step(pairs, letter)
            if after not in states:
                states[after] = len(order)
                order.append(after)
            row.append(states[after])
        rows.append(row)
    exact = lambda pairs, ends: any(e == 0 and n in ends for n, e in pairs)
    near = lambda pairs, ends: any(e == 1 and n in ends for n, e in pairs)
    accepts = [2 if exact(p, whole) else 3 if p == done or exact(p, stem) else 0 if exact(p, safe) else 1 if near(p, told) else 4 if near(p, loose) else 0 for p in order]
    return Lexicon(np.array(rows, np.int32), classes, np.array(accepts, np.int8))


def _tokens(text: str, known: dict[str, str] | None = None) -> set[str]:
    """The different words of a text; each is kept once in ``known``, however many texts have it."""
    known = {} if known is None else known
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = T.words(raw, np.array([0, len(raw)]), T.TOKEN)
    low = T.LOWER[raw].tobytes()
    words = {low[a:b].decode("utf-8", "ignore") for a, b in zip(start.tolist(), end.tolist(), strict=True)}
    return {known.setdefault(w, w) for w in words}


def _words_by_chance(a: int, b: int, share: float) -> float:
    """That at most ``b`` of a + b places are clean, each being toxic with probability ``share``."""
    log = lambda j: math.lgamma(a + b + 1) - math.lgamma(j + 1) - math.lgamma(a + b - j + 1)
    return sum(math.exp(log(j) + (a + b - j) * math.log(share) + j * math.log1p(-share)) for j in range(b + 1))


def _texts_by_chance(seen: int, usual: float) -> float:
    """The Poisson probability of at least ``seen`` where ``usual`` are expected."""
    if seen <= usual:
        return 1.0
    term, total, j = math.exp(seen * math.log(usual) - usual - math.lgamma(seen + 1)), 0.0, seen
    while term > 1e-9 * total:
        total, j = total + term, j + 1
        term *= usual / j
    return total


def _one_of_copies(texts: list[set[str]], alike: float = 0.5) -> list[set[str]]:
    """One text of each group of near copies, the largest: what copies share is evidence only once."""
    texts = sorted((v for v in texts if v), key=lambda v: (-len(v), sorted(v)))
    odd = np.random.default_rng(0).integers(1 << 63, size=16, dtype=np.uint64) | np.uint64(1)
    kept: dict[tuple, list[int]] = defaultdict(list)
    out = []
    for i, v in enumerate(texts):
        codes = np.array([zlib.crc32(w.encode()) for w in v], np.uint64)
        least = np.array([((codes + np.uint64(1)) * k >> np.uint64(20)).min() for k in odd]).reshape(8, 2).tolist()
        bands = [(n, *pair) for n, pair in enumerate(least)]
        if not any(len(v & texts[j]) >= alike * len(v | texts[j]) for j in {j for b in bands for j in kept[b]}):
            out.append(v)
            for b in bands:
                kept[b].append(i)
    return out


def token_sets(rows: list[tuple[str, int]]) -> list[tuple[set[str], int]]:
    known: dict[str, str] = {}
    return [(_tokens(t, known), y) for t, y in rows]


def choose_entries(rows: list[tuple[str, int]], sets: list[tuple[set[str], int]] | None = None) -> tuple[list[str], list[str]]:
    """(words, stems) that tell toxic texts from the others by document counts: all whose evidence is such that chance gives
    at most one entry of the kind. Words of many toxic texts also enter where the sample is too small for that."""
    toxic, clean = Counter(), Counter()
    sets = token_sets(rows) if sets is None else sets
    n1 = max(sum(1 for _, y in sets if y), 1)
    n0 = max(len(sets) - n1, 1)
    for words, y in sets:
        (toxic if y else clean).update(words)
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    size1, size = sum(len(v) for v, y in sets if y), sum(len(v) for v, _ in sets) or 1
    share = min(max(size1 / size, n1 / (n1 + n0)), 1 - 1e-9)
    # words too rare to be evidence in any case are not counted as tests
    times = Counter(toxic[w] + clean[w] for w in toxic.keys() | clean.keys() if len(w) >= 3)
    tests = lambda k: sum(n for t, n in times.items() if t >= k)
    tried = tests(next(k for k in range(3, len(sets) + 4) if share**k * tests(k) <= 1 or k > len(sets)))
    least = max(3, 0.08 * n1)
    apart = _one_of_copies([v for v, y in sets if y])
    told = Counter(w for v in apart for w in v)
    able = (w for w in toxic if toxic[w] >= 3 and len(w) >= 3 and odds(toxic[w], clean[w]) > 3 and clean[w] <= 0.002 * n0)
    good = [w for w in able if toxic[w] >= least or (told[w] >= 3 and _words_by_chance(told[w], clean[w], share) * tried <= 1)]
    words = sorted(good, key=lambda w: (-toxic[w] * odds(toxic[w], clean[w]), w))
    # stems: heavy ones for the length of the texts that no frequent word explains, and all that enough toxic texts have
    known = {w for w in words if toxic[w] >= least}
    clean_sets = [v for v, y in sets if not y]
    best: list[str] = []
    for texts, by_weight in (([v for v, y in sets if y and not v & known], True), (apart, False)):
        for p in _stems(texts, clean_sets, by_weight):
            if not any(p.startswith(q) or q.startswith(p) for q in best):
                best.append(p)
    return words, best


def _shared_prefixes(words: set[str], least: int, by: int = 4) -> dict[str, list[str]]:
    """The proper prefixes of each word, of ``least`` letters or more, that ``by`` different words have."""
    order = sorted(words)
    reach = [0] * len(order)
    for i in range(len(order) - by + 1):
        n = len(os.path.commonprefix([order[i], order[i + by - 1]]))  # also of all between
        if n >= least:
            for j in range(i, i + by):
                reach[j] = max(reach[j], n)
    return {w: [w[:n] for n in range(least, min(r + 1, len(w)))] for w, r in zip(order, reach, strict=True) if r >= least}


def _stems(texts: list[set[str]], clean: list[set[str]], by_weight: bool) -> list[str]:
    """Stems of toxic ``texts``, the heaviest first: those far heavier than chance stems, or those whose evidence by texts is
    such that chance gives at most one (long texts have most stems anyway)."""
    size1, size0 = sum(map(len, texts)) or 1, sum(map(len, clean)) or 1
    docs1, all1, all0 = Counter(), Counter(), Counter()
    prefixes = _shared_prefixes(set().union(*texts), LEAST_STEM)
    for words_of in texts:
        grouped = Counter(p for w in words_of for p in prefixes.get(w, ()))
        all1.update(grouped)
        docs1.update(grouped.keys())
    least = max(3, 0.04 * len(texts)) if by_weight else 3
    usual = {p for p, c in docs1.items() if c >= least}
    known = Counter(w for words_of in clean for w in words_of)
    longest = max(map(len, usual), default=0)
    for w, n in known.items():
        for k in range(LEAST_STEM, min(len(w), longest + 1)):
            if w[:k] in usual:
                all0[w[:k]] += n
    rate = {p: math.log((all1[p] / size1) / ((all0[p] + 0.5) / size0)) for p in usual}
    weight = {p: all1[p] * max(rate[p], 0) ** 2 for p in usual}
    top = max(weight.values(), default=0)  # chance stems are many, and far lighter than the others
    lengths = np.array([len(v) for v in texts], float)
    expected = lambda p: float(-np.expm1(-lengths * (all0[p] + 0.5) / size0).sum())
    enough = lambda p: weight[p] > 0.06 * top if by_weight else _texts_by_chance(docs1[p], expected(p)) * len(docs1) <= 1
    return sorted((p for p in usual if rate[p] > 2 and enough(p)), key=lambda p: (-weight[p], -len(p), p))


def _flags(data: bytes, start: np.ndarray, end: np.ndarray, i: int) -> int:
    """Of a hit at token ``i`` of a window: 1 between quotation marks, 2 near a word of saying, 4 near a second person."""
    near = {data[start[j] : end[j]].decode("utf-8", "ignore").lower() for j in range(len(start)) if j != i}
    before, after = data[: start[i]].decode("utf-8", "ignore"), data[end[i] :].decode("utf-8", "ignore")
    return bool(QUOTES & set(before) and QUOTES & set(after)) + 2 * bool(SAYING & near) + 4 * bool(SECOND_PERSON & near)


def _weights(hits: np.ndarray, factors: tuple[float, ...]) -> np.ndarray:
    """By context; an edit that does not tell weighs nothing."""
    return np.array([math.prod(f for b, f in enumerate(factors) if m >> b & 1) for m in range(8)])[hits[:, 3]] * (hits[:, 4] < 4)


def found(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits, tokens of each text): hits are rows (text, start, end, flags, kind) in order, with bytes of the text."""
    start, end, first = T.words(data, offsets, T.TOKEN)
    kinds = lexicon.match(data, start, end)
    at = np.flatnonzero(kinds)
    rows = np.searchsorted(first, at, "right") - 1
    flags = np.zeros(len(at), np.int64)
    for k, (i, d) in enumerate(zip(at.tolist(), rows.tolist(), strict=True)):
        a, b = max(int(first[d]), i - WINDOW), min(int(first[d + 1]), i + WINDOW + 1)
        flags[k] = _flags(data[start[a] : end[b - 1]].tobytes(), start[a:b] - start[a], end[a:b] - start[a], i - a)
    return np.stack([rows, start[at] - offsets[rows], end[at] - offsets[rows], flags, kinds[at].astype(np.int64)], 1), np.diff(first)


def _found_in(texts: list[str], lexicon: Lexicon, size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """``found`` in texts, about ``size`` bytes of them at once."""
    hits, tokens, begun, held = [], [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i == len(texts) - 1:
            raw = [x.encode() for x in texts[begun : i + 1]]
            some, counts = found(lexicon, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
            some[:, 0] += begun
            hits.append(some)
            tokens.append(counts)
            begun, held = i + 1, 0
    return np.concatenate([np.zeros((0, 5), np.int64), *hits]), np.concatenate([np.zeros(0, np.int64), *tokens])


def weighed(hits: np.ndarray, tokens: np.ndarray, factors: tuple[float, ...], stem_rate: float) -> np.ndarray:
    """For each text log(1 + weighed hits), exact and with an edit, whether there are any, and the excess of stems."""
    x = np.zeros((len(tokens), 5))
    np.add.at(x, (hits[:, 0], np.array([0, 1, 0, 4, 1])[hits[:, 4]]), _weights(hits, factors))
    x[:, 2:4] = x[:, :2] > 0
    x[:, :2] = np.log1p(x[:, :2])
    # stems also occur by chance: what counts is the excess over the rate in clean texts, as a signed root of the deviance
    usual = np.maximum(tokens * stem_rate, 1e-9)
    seen = x[:, 4]
    excess = np.sqrt(2 * np.maximum(seen * np.log(np.maximum(seen, 1e-9) / usual) - (seen - usual), 0))
    x[:, 4] = np.where(seen > usual, np.minimum(excess, 10), 0)
    return x


def features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray, stem_rate: float = 1e-3, factors: tuple[float, ...] = FACTORS) -> tuple[np.ndarray, list[tuple[int, int, int, float, int]]]:
    """(x, hits): ``weighed`` hits of each text, and (row, start, end, weight, kind) of each hit."""
    hits, tokens = found(lexicon, data, offsets)
    weights = _weights(hits, factors)
    return weighed(hits, tokens, factors, stem_rate), [(*h[:3], w, h[4]) for h, w in zip(hits.tolist(), weights.tolist(), strict=True)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method; the first weight is the bias, which is not shrunk."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(z.shape[1])
    shrink = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + shrink, z.T @ (p - y) + shrink @ w)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    stem_rate: float = 1e-3
    factors: tuple[float, ...] = FACTORS

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _strange(words: list[str], tokens: set[str]) -> set[str]:
    """The ``tokens`` that are no entry and within one edit of one."""
    lexicon = compile_lexicon(words, [], set(words))
    order = sorted(tokens)
    ends = np.cumsum([len(t.encode()) for t in order], dtype=np.int64)
    kinds = lexicon.match(np.frombuffer("".join(order).encode(), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if order else np.zeros(0)
    return {t for t, k in zip(order, kinds, strict=True) if k == 1}


def _one_edit(a: str, b: str) -> bool:
    x, y = sorted((a.encode(), b.encode()), key=len)
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def learn_edits(words: list[str], sets: list[tuple[set[str], int]]) -> tuple[set[str], set[str]]:
    """(entries whose edits tell, harmless words) from (tokens, toxic) of texts.

    Harmless words are gathered from one half of the clean texts; those of the other half with a strange word within one
    edit of an entry, both ways round, are held against MISSPELLED of the toxic texts that have the entry.
    """
    clean = [v for v, y in sets if not y]
    harmless = _strange(words, set().union(*clean))
    strange = Counter()
    for h in (0, 1):
        new = harmless - set().union(*clean[h::2])
        if new:
            for v in clean[1 - h :: 2]:
                strange.update({w for t in v & new for w in words if _one_edit(w, t)})
    seen = Counter(w for v, y in sets if y for w in v)
    n1, n0 = max(len(sets) - len(clean), 1), len(clean)
    odds = lambda w: math.log(max(MISSPELLED * seen[w] / n1, 1e-9) * (n0 + 1) / (strange[w] + 0.5))
    return {w for w in words if odds(w) > TELLING}, harmless


def _fit_factors(hits: np.ndarray, tokens: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, ...]:
    """The context factors under which the logistic model explains the sample best, one after the other, each held to its
    usual value by a penalty on the logarithm of what it departs by."""
    def loss(factors):
        x = weighed(hits, tokens, factors, rate)
        w = fit_logistic(x, y, rounds=8)
        z = w[0] + x @ w[1:]
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + sum(math.log(f / u) ** 2 for f, u in zip(factors, FACTORS, strict=True)))

    best = list(FACTORS)
    for i in [0, 1, 2] * 2:
        best[i] = min((best[i] * s for s in (1, 0.8, 0.6, 0.4, 1.25, 1.6, 2.5)), key=lambda f: loss((*best[:i], f, *best[i + 1 :])))  # noqa: B023
    return tuple(best)


def fit(rows: list[tuple[str, int]]) -> Model:
    if not rows:
        return Model(compile_lexicon([], []), np.array([-5.0, 0, 0, 0, 0, 0]))
    y = np.array([int(v) for _, v in rows], float)
    sets = token_sets(rows)
    words, stems = choose_entries(rows, sets)
    telling, harmless = learn_edits(words, sets)
    lexicon = compile_lexicon(words, stems, telling, harmless)
    # hits of each half by harmless words of the other one, as new texts will have them
    parts = []
    for h in (0, 1):
        others = set().union(*(v for v, toxic in sets[1 - h :: 2] if not toxic))
        apart = compile_lexicon(words, stems, telling, harmless & others)
        hits, tokens = _found_in([t for t, _ in rows[h::2]], apart)
        hits[:, 0] = hits[:, 0] * 2 + h
        parts.append((hits, tokens))
    del sets
    hits, tokens = np.concatenate([p[0] for p in parts]), np.zeros(len(rows), np.int64)
    for h in (0, 1):
        tokens[h::2] = parts[h][1]
    of_clean = hits[y[hits[:, 0]] == 0]
    rate = (np.count_nonzero(of_clean[:, 4] == 3) + 0.5) / max(int(tokens[y == 0].sum()), 1)
    factors = _fit_factors(hits, tokens, y, rate)
    x = weighed(hits, tokens, factors, rate)
    w = np.maximum(fit_logistic(x, y), [-np.inf, 0, 0, 0, 0, 0])
    # an edit alone counts by the odds that it tells: how often toxic texts have one, by the sample or else as usual, against
    # clean ones; but no more than the word itself. That the word is missing then says nothing, as the edit took it away
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    toxic = max(x[y > 0, 3].sum() / n1, MISSPELLED * x[y > 0, 2].sum() / n1, 1e-9)
    odds = math.log(n1 / n0) + math.log(toxic * (n0 + 1) / (x[y == 0, 3].sum() + 0.5))
    word = w[0] + w[3] + math.log(2) * w[1]
    w[4] = max(w[4], min(odds, word) - w[0] - math.log(2) * w[2], 0.0) if telling else 0.0
    return Model(lexicon, w, rate, factors)


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """From at most ``limit`` labelled texts that are not held out. A document with several labels counts as the greatest."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~learning.held_out())
    return fit(learning.sample(known.select("doc_id", "toxic"), "toxic", limit, docs))


def _scored(shared, text: str, finish):
    """``finish(rows, probabilities, hits as lists)`` of each slice."""
    def run(stream):
        m = shared.value
        for rows, data, at in T.batches(stream, text=text):
            hits, tokens = found(m.lexicon, data, at)
            p = m.score(weighed(hits, tokens, m.factors, m.stem_rate))
            columns = [pa.array(hits[:, 1]), pa.array(hits[:, 2]), pa.array(_weights(hits, m.factors)), pa.array((hits[:, 4] == 2) | (hits[:, 4] == 3))]
            parts = pa.StructArray.from_arrays(columns, ["start", "end", "weight", "exact"])
            yield finish(rows, p, pa.ListArray.from_arrays(pa.array(np.searchsorted(hits[:, 0], np.arange(len(at))).astype(np.int32)), parts))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) of each row of ``docs`` (doc_id, text, …); other columns are ignored.

    hits are (start, end, weight, exact) in bytes of the text. A null or empty text has no hits and the score that goes
    with none; repeated rows come back as often, an empty table gives none.
    """
    shared = importable(docs.sparkSession).sparkContext.broadcast(model)  # bounded by the sample

    def finish(rows, p, lists):
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), lists], ["doc_id", "held_out", "score", "predicted", "hits"])

    given = docs.select("doc_id", "text").withColumn("held_out", learning.held_out())
    return given.mapInArrow(T.tidy(_scored(shared, "text", finish)), "doc_id long, held_out boolean, score double, predicted int, hits array<struct<start:long,end:long,weight:double,exact:boolean>>")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever these are called. Odd rows as in ``score``."""
    shared = importable(docs.sparkSession).sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(docs.columns))]
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)])
    keep = _scored(shared, names[docs.columns.index("text")], lambda rows, p, _: rows.filter(pa.array(p < 0.5)))
    return given.mapInArrow(T.tidy(keep), given.schema).select(*[F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)])
