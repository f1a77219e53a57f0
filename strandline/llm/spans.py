"""Removing byte strings that also start earlier in the corpus, by external suffix sorting of shards.

All windows of ``width`` bytes are to be compared, each with all earlier ones. Shards for that come from the text itself:
a window's anchor is the place of its least GRAM-byte hash, so equal windows have equal anchors, and neighbouring windows
mostly one anchor. Windows with one anchor are a stretch, and a stretch is a shard's unit:

1. Stretches are named by hash, like the substrings of an induced sort. One that occurs once by anchor has only unique
   windows. Of stretches that are equal as wholes, all but the earliest are removed as wholes; copies end here.
2. Different stretches with the same anchor are cut into blocks of windows at fixed distances from the anchor, and go to
   shards by the bytes that all windows of a block share. A passage in many documents thus meets only the same bytes of
   its other occurrences. Those shared bytes become one symbol, by their hash, as equal substrings do when an induced
   sort goes down a level; a block is what stands before it, that symbol, and what stands behind. Equal blocks are
   removed like equal stretches. The rest of each shard is a text whose suffixes are sorted by ``inducing``: with queues on disk, common
   prefixes carried along. Runs of prefixes of the full width are equal windows; all but the earliest are removed.

Common anchors, as of a line that stands in many documents, are found beforehand in a sample of the documents. Their
stretches are dealt by name as well, and what is left of them goes on as single windows, dealt by the window's hash: no
anchor's rows meet in one task. Tasks settle what they have seen earlier themselves, so that a common stretch or window leaves
each of them few times. The sample decides how rows are dealt, and nothing else.

A task holds a slice of texts or rows, tables of fixed size, and what ``inducing`` holds; a shard's blocks and what is removed
of them wait on disk. Only hashes of stretches, and texts of ambiguous ones, are shuffled. The two results are joined to
the documents by id and a fingerprint of the text.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import inducing
from strandline.llm import textbuf as T
from strandline.sources.shared import importable, shared_checkpoint

U = np.uint64
GRAM, BLOCK = 24, 8
#: Bytes looked at together; longer texts are cut with an overlap, which only moves stretches' ends.
PIECE = 1 << 19
PLACE_BITS = 24
#: A place is start << 32 | hot flag | print << 8 | done flag | windows; a stretch has PART windows at most.
PART, DONE, PRINT, HOT = 96, 128, (1 << 23) - 1, 1 << 31
#: One document in SAMPLED is asked for common anchors: those of a share of COMMON or more of its stretches; a task remembers
#: SLOTS stretches or windows.
SAMPLED, COMMON, SLOTS = 16, 1e-3, 1 << 17
NO_ID = -(1 << 63)


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of the window at each place, hashes of grams, prefix sums)."""
    sums = T.prefix_sums(data)
    n = len(data) - GRAM + 1
    power = T.powers(len(data))[1]
    grams = T.mix((sums[GRAM:] - sums[:-GRAM]) * power[:n])
    mask = U((1 << PLACE_BITS) - 1)
    least = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    span, want = 1, width - GRAM + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    return (least & mask).astype(np.int64), grams, sums


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, name) of each stretch; starts count from the row's first byte."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < width:
        return none
    at, grams, sums = anchors(data, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + width <= offsets[row + 1])
    if not len(inside):
        return none
    own = at[inside]
    new = np.ones(len(own), bool)
    part = (own - inside) // PART  # by the distance from the anchor, so that equal windows fall alike
    new[1:] = (own[1:] != own[:-1]) | (row[inside][1:] != row[inside][:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    first = inside[head]
    count = np.diff(np.append(head, len(own)))
    anchor = own[head]
    name = T.mix(T.span_hash(sums, first, first + count - 1 + width) ^ ((anchor - first).astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    gram = grams[anchor] ^ (part[head].astype(np.uint64) * U(0xD1B54A32D192ED03))
    return row[first], first - offsets[row[first]], count, gram, name


def _pieces(data: np.ndarray, at: np.ndarray, width: int):
    """(offsets of rows, row numbers, first byte in its row) over parts of a slice that are not too long."""
    if len(data) <= 2 * PIECE:
        yield data, at, np.arange(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        return
    for d in range(len(at) - 1):
        for low in range(int(at[d]), max(int(at[d + 1]) - width + 1, int(at[d]) + 1), PIECE):
            part = data[low : min(low + PIECE + width - 1, int(at[d + 1]))]
            yield part, np.array([0, len(part)]), np.array([d]), np.array([low - at[d]])


class Recent:
    """Names that a task has sent on lately, each with the earliest place sent; a table of fixed size."""

    def __init__(self):
        self.name, self.key, self.start = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.full(SLOTS, -1, np.int64)

    def settles(self, name: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of the rows, all of different names, come after one sent already; the others are noted as sent."""
        slot = (name >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        known = (self.name[slot] == name) & (self.start[slot] >= 0)
        late = known & ((self.key[slot] < key) | ((self.key[slot] == key) & (self.start[slot] < start)))
        now = np.flatnonzero(~late)
        self.name[slot[now]], self.key[slot[now]], self.start[slot[now]] = name[now], key[now], start[now]
        return late


def _common(width: int):
    """(gram, n): anchors that a task's documents have often, and at gram 0 all their stretches.

    A bounded list is kept (Misra-Gries): what is dropped from it occurs seldom.
    """
    most = int(4 / COMMON)

    def run(stream):
        names, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for _, data, at in T.batches(stream, PIECE):
            for part, offsets, _, _ in _pieces(data, at, width):
                gram = stretches(part, offsets, width)[3]
                total += len(gram)
                names, where = np.unique(np.concatenate([names, gram]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, np.ones(len(gram))]), len(names)).astype(np.int64)
                if len(names) > most:
                    counts -= np.sort(counts)[-most - 1]
                    names, counts = names[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names.view(np.int64), 0)), pa.array(np.append(counts, total))], ["gram", "n"])

    return run


def common_anchors(given: DataFrame, width: int) -> np.ndarray:
    """The anchors of at least COMMON of the stretches of sampled documents: 1 / COMMON of them at most."""
    some = given.where(F.pmod(F.xxhash64("key", "text"), F.lit(SAMPLED)) == 0).select("key", "text")
    counted = shared_checkpoint(some.mapInArrow(_common(width), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counted.where("gram = 0").head()
    rows = counted.where(F.col("gram") != 0).where(F.col("n") >= max(COMMON * total.n, 64)).select("gram").collect() if total else []
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def _name(width: int, common):
    def run(stream):
        known, recent = common.value, Recent()
        for rows, data, at in T.batches(stream, PIECE):
            keys, prints = rows.column("key").to_numpy(), rows.column("print").to_numpy()
            for part, offsets, numbers, begin in _pieces(data, at, width):
                row, start, count, gram, name = stretches(part, offsets, width)
                if not len(row):
                    continue
                key = keys[numbers[row]]
                pos = ((start + begin[row]) << 32) | (prints[numbers[row]] << 8) | count
                gram = gram.copy()
                # equal stretches of this slice: the earliest stands for them, the others are settled here
                order = np.lexsort((pos, key, name, gram))
                g, m, k, p = gram[order], name[order], key[order], pos[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (m[1:] != m[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
                late = (k != k[head]) | (p >> 32 != p[head] >> 32)
                # and so are those that this task has sent an earlier one of
                first = np.flatnonzero(new)
                seen = np.zeros(len(g), bool)
                seen[first] = recent.settles(T.mix(g[first]) ^ m[first], k[first], p[first] >> 32)
                late |= seen[head]
                hot = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g if len(known) else np.zeros(len(g), bool)
                g = np.where(late, T.mix(k.astype(np.uint64)), np.where(hot, T.mix(g ^ m), g))
                p = p | np.where(late, DONE, 0) | np.where(hot, HOT, 0)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(m.view(np.int64)), pa.array(k), pa.array(p)], ["gram", "name", "key", "pos"])

    return run


def _settle(stream):
    """Rows sorted by (gram, name, key, pos) to removed stretches (kind 0), earliest ones with rivals (2) and hot earliest ones (3).

    Of an open group only its anchor, its last name with the earliest place, and a first stretch not yet sent are held.
    """
    state = None  # gram, name, earliest key, earliest place, the stretch that is held back or None
    for batch in stream:
        if not batch.num_rows:
            continue
        gram, name, key, pos = (batch.column(c).to_numpy() for c in ("gram", "name", "key", "pos"))
        done = pos & DONE > 0
        out = [(key[done], pos[done] & ~DONE, gram[done], np.zeros(done.sum(), np.int32))]
        gram, name, key, pos = gram[~done], name[~done], key[~done], pos[~done]
        if len(gram):
            new_gram = np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new = new_gram.copy()
            new[1:] |= name[1:] != name[:-1]
            goes_on = state is not None and gram[0] == state[0]
            if goes_on:
                new_gram[0] = False
                new[0] = name[0] != state[1]
            index = np.where(new, np.arange(len(gram)), -1)
            head = np.maximum.accumulate(index)
            hk = np.where(head >= 0, key[head], state[2] if state else 0)
            hp = np.where(head >= 0, pos[head] >> 32, state[3] if state else 0)
            late = (key != hk) | (pos >> 32 != hp)
            out.append((key[late], pos[late], gram[late], np.zeros(late.sum(), np.int32)))
            group = np.cumsum(new_gram)  # 0: the group that goes on
            names = np.bincount(group[new], minlength=group[-1] + 1)
            if goes_on:
                names[0] += 1
                if state[4] is not None and names[0] > 1:
                    k, p, g = state[4]
                    out.append((np.array([k]), np.array([p]), np.array([g]), np.array([2], np.int32)))
            hot = pos & HOT > 0
            rivals = new & (hot | (names[group] > 1))
            out.append((key[rivals], pos[rivals], gram[rivals], np.where(hot[rivals], 3, 2).astype(np.int32)))
            end = len(gram) - 1
            if names[group[end]] == 1 and not hot[end]:
                held = state[4] if goes_on and group[end] == 0 else (int(key[head[end]]), int(pos[head[end]]), int(gram[end]))
            else:
                held = None
            state = (gram[end], name[end], hk[end], hp[end], held)
        key, pos, gram, kind = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(gram), pa.array(kind)], ["key", "pos", "gram", "kind"])


def _cut(width: int):
    """Blocks of ambiguous stretches with their bytes, routed by the bytes that all windows of a block share; windows of hot
    stretches, routed by their hash: cut at WINDOW, or at LATE if the task has sent an earlier one."""
    core = width - BLOCK + 1

    def run(stream):
        recent = Recent()
        for batch in stream:
            out, held = [], 0
            for key, mark, text, places in zip(*(batch.column(c).to_pylist() for c in ("key", "print", "text", "places")), strict=True):
                raw = text.encode()
                single: list[int] = []
                for pos in places:
                    start, count = pos >> 32, pos & 127
                    if pos & HOT:
                        single += range(start, start + count)
                        continue
                    grams = anchors(np.frombuffer(raw[start : start + width], np.uint8), width)[0]
                    anchor = start + int(grams[0])
                    for b in range((anchor - (start + count - 1)) // BLOCK, (anchor - start) // BLOCK + 1):
                        low, high = max(start, anchor - b * BLOCK - BLOCK + 1), min(start + count - 1, anchor - b * BLOCK)
                        at = anchor - b * BLOCK
                        route = xxhash.xxh3_64_intdigest(raw[at : at + core], b) - (1 << 63)
                        out.append((route, at - low, raw[low:at] + raw[at + core : high + width], key, mark, low))
                        held += 64
                if single:
                    of = {}
                    for w in sorted(single):
                        of.setdefault(xxhash.xxh3_64_intdigest(raw[w : w + width]), []).append(w)
                    names = np.array(list(of), np.uint64)
                    late = recent.settles(names, np.full(len(of), key, np.int64), np.array([x[0] for x in of.values()], np.int64))
                    for (name, windows), gone in zip(of.items(), late.tolist(), strict=True):
                        for i, w in enumerate(windows):
                            settled = gone or i > 0
                            route = xxhash.xxh3_64_intdigest(b"%d %d" % (key, w)) if settled else name
                            out.append((route - (1 << 63), LATE if settled else WINDOW, bytes(BLOCK - 1), key, mark, w))
                    held += 64 * len(single)
                if held > 4 << 20:
                    yield _blocks(out)
                    out, held = [], 0
            if out:
                yield _blocks(out)

    return run


LATE, WINDOW = -2, -1
BLOCK_COLUMNS = ["route", "before", "edges", "key", "print", "start"]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], BLOCK_COLUMNS)


RANGE_COLUMNS = ["key", "print", "low", "high"]


def _sort_shard(width: int, held: int):
    """Blocks sorted by route, content and place to removed ranges.

    Of equal blocks all but the earliest go at once; different ones with one route make up the shard's text. That, and what
    goes at once, wait in files until the task's rows have all come.
    """
    core = width - BLOCK + 1

    def run(stream):
        with tempfile.TemporaryDirectory(dir=inducing.scratch_dir()) as work:
            path, shard = os.path.join(work, "whole"), inducing.Shard(work, held)

            def take(symbol, row):
                raw = np.frombuffer(row[2], np.uint8).astype(np.int32)
                shard.add(row[3], row[5], np.concatenate([raw[: row[1]], [symbol], raw[row[1] :]]), row[4])

            with open(path, "wb") as whole:
                before, sent, symbol = None, False, 255
                for batch in stream:
                    gone = []
                    for row in zip(*(batch.column(c).to_pylist() for c in BLOCK_COLUMNS), strict=True):
                        if row[1] == LATE:
                            gone.append((row[3], row[4], row[5], row[5] + width))
                        elif before is not None and before[:3] == row[:3]:
                            if before[3] != row[3] or before[5] != row[5]:
                                gone.append((row[3], row[4], row[5], row[5] + len(row[2]) + core))
                        else:
                            if before is not None and before[0] == row[0] and row[1] != WINDOW != before[1]:
                                if not sent:
                                    symbol += 1
                                    take(symbol, before)
                                take(symbol, row)
                                sent = True
                            else:
                                sent = False
                            before = row
                    whole.write(np.array(gone, np.int64).tobytes())
            for segment, place in shard.repeated(BLOCK):
                if not len(segment):
                    continue
                order = np.lexsort((place, segment))
                s, p = segment[order], place[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(s)) - 1
                _, key, start, mark = shard.rows[s[head]].T
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mark), pa.array(start + p[head]), pa.array(start + p[tail] + width)], RANGE_COLUMNS)
            with open(path, "rb") as whole:
                while len(rows := np.fromfile(whole, np.int64, 4 << 16).reshape(-1, 4)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], RANGE_COLUMNS)

    return run


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


KINDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64()))}


def _remove(with_bytes: bool):
    """Rows (doc_id, text, ranges) to what is removed, and to the bytes that remain if they are asked for."""
    kinds = KINDS | ({"kept": pa.binary()} if with_bytes else {})

    def run(stream):
        for batch in stream:
            rows, held = [], 0
            for doc, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                spans = merged(ranges)
                kept, at, parts = hashlib.sha256(), 0, []
                for a, b in [*spans, (len(raw), len(raw))]:
                    kept.update(raw[at:a])
                    if with_bytes:
                        parts.append(raw[at:a])
                    at = b
                rows.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [list(s) for s in spans], b"".join(parts)))
                held += len(rows[-1][-1])
                if held > 16 << 20:
                    yield _rows(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, kinds)

    return run


def _rows(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def repeated_spans(docs: DataFrame, width: int = 100, held: int = inducing.HELD, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of ``docs`` (doc_id, text, …); with_bytes adds kept.

    Removed are all bytes in a ``width``-byte string that also starts earlier: in a row with a smaller doc_id, or at an
    earlier place of a row with the same one. A null doc_id counts as smaller than all. Rows that repeat a doc_id and text
    never remove each other at the same place. Texts are UTF-8 bytes, null is empty; spans may cut a character. Other
    columns are ignored; an empty table gives none. ``width`` is GRAM or more, and texts are shorter than 2^31 bytes.
    """
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    spark = importable(docs.sparkSession)
    mark = F.xxhash64("text").bitwiseAND(F.lit(PRINT))  # never null, so that neither join adds a filter
    given = docs.select("doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), mark.alias("print"), F.coalesce("text", F.lit("")).alias("text"))
    long_enough = given.where(F.octet_length("text") >= width)
    common = spark.sparkContext.broadcast(common_anchors(long_enough, width))  # 1 / COMMON hashes at most
    named = long_enough.select("key", "print", "text").mapInArrow(_name(width, common), "gram long, name long, key long, pos long")
    settled = named.repartition("gram").sortWithinPartitions("gram", "name", "key", "pos").mapInArrow(_settle, "key long, pos long, gram long, kind int")
    settled = shared_checkpoint(settled)
    placed = settled.withColumn("print", F.shiftright("pos", 8).bitwiseAND(PRINT))
    start = F.shiftright("pos", 32)
    whole = placed.where("kind = 0").select("key", "print", start.alias("low"), (start + F.col("pos").bitwiseAND(127) - 1 + width).alias("high"))
    rivals = placed.where("kind >= 2").groupBy("key", "print").agg(F.collect_list("pos").alias("places"))
    # both joins take the same columns, so that the texts are shuffled once and the exchange is used again
    blocks = given.join(rivals.hint("shuffle_hash"), ["key", "print"]).select("doc_id", "key", "print", "text", "places").mapInArrow(_cut(width), "route long, before long, edges binary, key long, print long, start long")
    shards = blocks.repartition("route").sortWithinPartitions("route", "before", "edges", "key", "start").mapInArrow(_sort_shard(width, held), "key long, print long, low long, high long")
    ranges = whole.unionByName(shards).groupBy("key", "print").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    found = given.join(ranges.hint("shuffle_hash"), ["key", "print"], "left").select("doc_id", "text", "ranges")
    more = ", kept binary" if with_bytes else ""
    return found.mapInArrow(_remove(with_bytes), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>{more}")


def deduplicated(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, kept): the bytes that remain of each row. Rows with one doc_id and different texts each keep their own."""
    return repeated_spans(docs, width, with_bytes=True).select("doc_id", "kept")
