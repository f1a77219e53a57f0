"""Languages of texts and of their parts.

Every word gets a score for each language: the sum of log likelihood ratios of its byte 4-grams, which start and end in a
space. The script of its letters, read from ranges of UTF-8 lead bytes, leaves only languages seen with that script.
Viterbi over the words, with a penalty for each switch, labels spans; the language with most letters names the text.

All is done on arrays over many texts at once: 4-grams of a slice are one gather, and the texts of a slice step through
their words together, longest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import learning
from strandline.llm import textbuf as T
from strandline.sources.shared import importable

U = np.uint64
BITS, SWITCH, OTHER_SCRIPT = 18, 6.0, -50.0
#: Labelled texts that are learned from, at most.
SAMPLE = 2_000
# fixed values: script by UTF-8 lead byte (of code points from 0x80 on; ASCII letters are Latin)
SCRIPTS = {"latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)], "armenian_hebrew": [0xD4, 0xD5, 0xD6, 0xD7], "arabic": [*range(0xD8, 0xDC)], "south_asian": [0xE0], "other_asian": [0xE1], "han_kana": [*range(0xE3, 0xEA)], "hangul": [*range(0xEA, 0xEE)]}
SCRIPT_OF = np.zeros(256, np.uint16)
for _bit, _bytes in enumerate(SCRIPTS.values()):
    SCRIPT_OF[_bytes] = 1 << _bit


def gram_slots(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bounds): the hashed 4-grams of ' word ', a word of n bytes having max(n - 1, 1) of them."""
    n = end - start
    count = np.maximum(n - 1, 1)
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(start, count) - 1
    low, high = np.repeat(start, count), np.repeat(end, count)
    key = np.zeros(len(at), np.uint64)
    for i in range(4):
        p = at + i
        c = T.LOWER[data[np.clip(p, 0, max(len(data) - 1, 0))]].astype(np.uint64)
        key = (key << U(8)) | np.where((p >= low) & (p < high), c, U(32))
    return (T.mix(key) >> U(64 - BITS)).astype(np.int64), bounds


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (slot, language)
    scripts: np.ndarray  # of each language

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), len(self.languages)), np.float32)
        if not len(start):
            return out
        slots, bounds = gram_slots(data, start, end)
        for i in range(len(self.languages)):
            out[:, i] = np.add.reduceat(self.weights[slots, i], bounds[:-1])
        kinds = np.bitwise_or.reduceat(SCRIPT_OF[data], np.stack([start, np.minimum(end, len(data) - 1)], 1).ravel())[::2] if len(data) > 1 else SCRIPT_OF[data][:1]
        off = (kinds[:, None] & self.scripts[None]) == 0
        known = ~off.all(1) & (kinds > 0)
        out[off & known[:, None]] += OTHER_SCRIPT
        out[~known & (kinds == 0)] = 0
        return out


def fit(rows: list[tuple[str, str]], alpha: float = 0.5) -> Model:
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.uint16))
    counts = np.full((1 << BITS, len(languages)), 0.0)
    letters = np.zeros((len(languages), len(SCRIPTS)))
    for text, y in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        start, end, _ = T.words(raw, np.array([0, len(raw)]))
        if len(start):
            counts[:, languages.index(y)] += np.bincount(gram_slots(raw, start, end)[0], minlength=1 << BITS)
            letters[languages.index(y)] += [np.count_nonzero(SCRIPT_OF[raw] == 1 << b) for b in range(len(SCRIPTS))]
    seen = max(int((counts.sum(1) > 0).sum()), 1)
    logs = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * seen)
    shares = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    scripts = np.array([sum(1 << b for b in range(len(SCRIPTS)) if s[b] >= 0.01) for s in shares], np.uint16)
    return Model(languages, (logs - logs.mean(1, keepdims=True)).astype(np.float32), scripts)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word: the path of each text with the greatest sum of scores, less ``switch`` for each change."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, size = first[:-1][order], n[order]
    best = np.zeros(scores.shape[0], np.int16)
    stays = np.ones(scores.shape, bool)
    value = np.zeros((len(order), scores.shape[1]), np.float64)
    alive = len(order)
    steps = int(size[0]) if len(size) else 0
    counts = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    for t in range(steps):
        alive = int(counts[t])
        at = begin[:alive] + t
        v = value[:alive]
        if t:
            top = v.argmax(1)
            best[at] = top
            jump = v[np.arange(alive), top][:, None] - switch
            stays[at] = v >= jump
            np.maximum(v, jump, out=v)
        v += scores[at]
        if t & 63 == 63:
            v -= v.max(1, keepdims=True)
    labels = np.zeros(scores.shape[0], np.int16)
    now = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        alive = int(counts[t])
        at = begin[:alive] + t
        state = now[:alive]
        labels[at] = state
        now[:alive] = np.where(stays[at, state], state, best[at])
    return labels


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace"))
    return out


def _label(model: Model):
    def run(stream):
        names = np.array([*model.languages, "und"], object)
        for rows, data, at in T.batches(stream):
            start, end, first = T.words(data, at)
            labels = viterbi(model.word_scores(data, start, end), first)
            row = np.repeat(np.arange(len(at) - 1), np.diff(first))
            letters = np.concatenate([[0], np.cumsum(SCRIPT_OF[data] > 0)])
            weight = letters[end] - letters[start] if len(start) else np.zeros(0, np.int64)
            k = len(model.languages)
            mass = np.bincount(row * k + labels, weight + 1e-6, (len(at) - 1) * k).reshape(-1, k)
            pick = np.where(has_letter(data, at), mass.argmax(1), k)
            score = np.where(pick < k, mass.max(1) / np.maximum(mass.sum(1), 1e-9), 0.0)
            # spans: runs of equal labels within a text, in bytes
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
            opens = np.flatnonzero(new)
            closes = np.concatenate([opens[1:], [len(labels)]])[: len(opens)] - 1
            base = at[row[opens]] if len(opens) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array((start[opens] - base).astype(np.int64)), pa.array((end[closes] - base).astype(np.int64)), pa.array(names[labels[opens]], pa.string())], ["start", "end", "lang"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, first).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(names[pick], pa.string()), pa.array(np.clip(score, 0, 1)), lists], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def learn(docs: DataFrame, limit: int = SAMPLE) -> Model:
    """From at most ``limit`` texts with a language that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~learning.held_out())
    return fit(learning.sample(labelled.select("doc_id", "lang"), "lang", limit, docs))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of each row of ``docs`` (doc_id, text, and lang if no model is given).

    spans are (start, end, lang) in bytes of the text; score is the predicted language's share of the letters. A text
    that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned.
    """
    spark = importable(docs.sparkSession)
    model = model or learn(docs)
    given = docs.select("doc_id", learning.held_out().alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    if not model.languages:
        return given.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<struct<start:long,end:long,lang:string>>").alias("spans"))
    shared = spark.sparkContext.broadcast(model)  # 2^18 slots for each language, however many texts there are

    def run(stream):
        yield from _label(shared.value)(stream)

    return given.mapInArrow(T.tidy(run), schema)
