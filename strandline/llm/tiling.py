"""Benchmark decontamination by greedy string tiling.

Texts and items are sequences of tokens: letters and digits, A-Z in lower case, punctuation ignored. Seeds are runs of SEED
tokens (an item that has fewer: all of them). Documents and items are joined by shared seeds. For a pair, tiles are laid
greedily: the longest run of tokens that both have and no tile overlaps is marked, again and again, until none of a seed's
length is left. Lengths are tried by running Karp-Rabin hashes of all free windows. Tiles may lie in any order, so reordered
passages add up. An item whose tokens are covered to COVER of their number contaminates the document.

The join needs not all seeds. The tokens of an item that its left-out seeds cover are fewer than the threshold asks for, so
a document that reaches it has one of the others; left out are those that most items share. Seeds of documents pass a bitmap
of the items' seeds where they are read, whose size is fixed; what passes by chance finds no partner in the join. Nothing
else of the benchmark reaches driver or tasks but by shuffles, and texts meet items one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbuf as T
from strandline.sources.shared import importable, shared_checkpoint

U = np.uint64
SEED, COVER = 5, 0.5
#: log2 of the bits of the bitmap; and into how many parts the documents of a seed are dealt.
BITS, SALTS = 24, 8
#: Contaminated texts up to this number are sent to all tasks by ``clean``; more are shuffled.
FEW = 200_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = T.words(data, offsets, T.TOKEN)
    return T.word_hashes(data, start, end), first


class Windows:
    """Karp-Rabin hashes of the windows of a token sequence that no tile overlaps."""

    def __init__(self, h: np.ndarray, free: np.ndarray):
        self.h, self.free = h, free
        self.power = T.powers(len(h))
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * self.power[0][: len(h)], out=self.sums[1:])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the free windows of ``n`` tokens."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[:-n]) if len(self.h) >= n else np.zeros(0, np.int64)
        return at, (self.sums[at + n] - self.sums[at]) * self.power[1][at]


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED, usable: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the tiles, longest first, then by place in the item, then in the text.

    ``usable`` marks the tokens of ``text`` that may be covered. If windows of some length are shared, so are shorter ones:
    the longest is found by halving. All tiles of one length are laid in one pass over its windows, since a place that is
    taken never gets free; so repeated words cost no more than others.
    """
    ours = Windows(item, np.ones(len(item), bool))
    theirs = Windows(text, np.ones(len(text), bool) if usable is None else usable.copy())
    shared = lambda n: bool(np.isin(ours.of(n)[1], theirs.of(n)[1]).any())
    tiles, top = [], min(len(item), len(text))
    while top >= least and shared(least):
        low = least
        while low < top:
            middle = (low + top + 1) // 2
            low, top = (middle, top) if shared(middle) else (low, middle - 1)
        n, (at, keys), (places, found) = low, ours.of(low), theirs.of(low)
        order = np.argsort(found, kind="stable")
        places, found = places[order].tolist(), found[order]
        begin, end = np.searchsorted(found, keys), np.searchsorted(found, keys, "right")
        untried: dict[int, int] = {}
        for i, a, b in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True):
            if a == b or not ours.free[i : i + n].all():
                continue
            p = untried.get(a, a)
            while p < b:
                j, p = places[p], p + 1
                if theirs.free[j : j + n].all() and (item[i : i + n] == text[j : j + n]).all():
                    ours.free[i : i + n] = theirs.free[j : j + n] = False
                    tiles.append((i, j, n))
                    break
            untried[a] = p
        top = n - 1
    return tiles


def needed(n: int, cover: float) -> int:
    """The least whole number of tokens that is ``cover`` of ``n``, and one at least."""
    return max(int(np.ceil(cover * n)), 1)


def _seeds_of_items(stream):
    """Rows (item, text) to (item, n, place, seed)."""
    for rows, data, at in T.batches(stream):
        h, first = tokens(data, at)
        count = np.diff(first)
        for width in range(1, SEED + 1):
            keys, bounds = T.shingle_hashes(h, first, width, False)
            row = np.repeat(np.arange(len(count)), np.diff(bounds))
            own = np.minimum(count[row], SEED) == width
            row, place = row[own], (np.arange(len(keys)) - bounds[row])[own]
            if len(row):
                yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(row)), pa.array(count[row].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(keys[own].view(np.int64))], ["item", "n", "place", "seed"])


def _asked(cover: float):
    """Rows (item, n, seeds of (usual, place, seed), commonest first) to the seeds that are joined."""
    def run(stream):
        for batch in stream:
            out = []
            for item, n, seeds in zip(*(batch.column(c).to_pylist() for c in ("item", "n", "seeds")), strict=True):
                width, covered, open_, kept = min(n, SEED), np.zeros(n, bool), True, set()
                for s in seeds:
                    span = covered[s["place"] : s["place"] + width]
                    if open_ and covered.sum() + (~span).sum() < needed(n, cover):
                        span[:] = True
                    else:
                        open_ = False
                        kept.add(s["seed"])
                out += [(item, width, s) for s in kept]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["item", "width", "seed"])

    return run


def _bits(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for each seed."""
    shift = U(64 - bits)
    return (seeds >> shift).astype(np.int64), (T.mix(seeds) >> shift).astype(np.int64)


def _bit_rows(bits: int):
    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(batch.column("seed").to_numpy().view(U), bits)))], ["bit"])

    return run


def _found_seeds(shared, widths: list[int], bits: int):
    """Rows (doc_id, text) that have a seed in the bitmap, with these seeds."""
    def run(stream):
        known = np.zeros((1 << bits) // 8, np.uint8)
        for bucket, raw in shared.value:
            known[bucket * 4096 : bucket * 4096 + len(raw)] = np.frombuffer(raw, np.uint8)[: len(known)]
        known = np.unpackbits(known, bitorder="little").astype(bool)
        for rows, data, at in T.batches(stream):
            h, first = tokens(data, at)
            row, seed = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for width in widths:
                keys, bounds = T.shingle_hashes(h, first, width, False)
                a, b = _bits(keys, bits)
                hit = np.flatnonzero(known[a])
                hit = hit[known[b[hit]]]
                row.append(np.searchsorted(bounds, hit, "right") - 1)
                seed.append(keys[hit])
            row, seed = np.concatenate(row), np.concatenate(seed)
            if len(row):
                order = np.lexsort((seed, row))
                row, seed = row[order], seed[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
                row, seed = row[new], seed[new]
                docs = np.unique(row)
                picked = rows.take(pa.array(docs))
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, docs), len(row)).astype(np.int32)), pa.array(seed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([picked.column("doc_id"), picked.column("text"), lists], ["doc_id", "text", "seeds"])

    return run


class Text:
    """Tokens of a document, with its windows of each seed width in order of their hash."""

    def __init__(self, h: np.ndarray):
        self.h, self.sorted = h, {}

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.sorted:
            keys = T.shingle_hashes(self.h, np.array([0, len(self.h)]), width, False)[0]
            order = np.argsort(keys, kind="stable")
            self.sorted[width] = keys[order], order
        return self.sorted[width]


def covered(item: np.ndarray, text: Text, cover: float) -> tuple[int, int] | None:
    """(covered tokens, tiles) of an item that ``text`` contains, else None."""
    n, width = len(item), min(len(item), SEED)
    if not n or len(text.h) < width:
        return None
    keys, order = text.windows(width)
    own = T.shingle_hashes(item, np.array([0, n]), width, False)[0]
    begin, end = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
    most = np.zeros(n + 1, np.int64)
    np.add.at(most, np.flatnonzero(end > begin), 1)
    np.add.at(most, np.flatnonzero(end > begin) + width, -1)
    if np.count_nonzero(np.cumsum(most)) < needed(n, cover):  # seeds cover all that tiles can
        return None
    spans = {(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b > a}
    at = np.sort(np.concatenate([order[a:b] for a, b in spans]))
    edge = np.zeros(len(text.h) + 2, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    near = np.cumsum(edge)[: len(text.h)] > 0
    keep = np.flatnonzero(near | np.concatenate([[False], near[:-1]]))  # one unusable token parts stretches
    tiles = tile(item, text.h[keep], width, near[keep])
    total = sum(size for _, _, size in tiles)
    return (total, len(tiles)) if total >= needed(n, cover) else None


def _laid(cover: float):
    """Rows sorted by (row, kind): a document (kind 0), then the items that it may contain (kind 1), one after the other."""
    def run(stream):
        own = None  # row, id, print, tokens
        for batch in stream:
            out = []
            for rows, data, at in T.batches([batch] if batch.num_rows else []):
                h, first = tokens(data, at)
                name = rows.column("row").to_numpy()
                for d, (kind, ident) in enumerate(zip(rows.column("kind").to_pylist(), rows.column("id").to_pylist(), strict=True)):
                    part = h[first[d] : first[d + 1]]
                    if kind == 0:
                        own = (name[d], ident, rows.column("print")[d].as_py(), Text(part.copy()))
                    elif own is not None and own[0] == name[d] and (found := covered(part, own[3], cover)):
                        out.append((own[1], own[2], ident, len(part), found[0], found[0] / len(part), found[1]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return run


SCHEMA = "doc_id long, print long, item_id long, item_tokens long, covered long, coverage double, tiles long"


def _matched(docs: DataFrame, benchmark: DataFrame, cover: float, bits: int) -> DataFrame:
    """``contaminations`` with the hash of the document's text as ``print``."""
    spark = importable(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = shared_checkpoint(items.withColumn("item", F.monotonically_increasing_id()))
    places = items.select("item", "text").mapInArrow(T.tidy(_seeds_of_items), "item long, n int, place int, seed long")
    usual = places.groupBy("seed").agg(F.count_distinct("item").alias("usual"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("usual")).alias("usual"), "place", "seed")))
    asked = places.join(usual, "seed").groupBy("item", "n").agg(ranked.alias("seeds")).mapInArrow(T.tidy(_asked(cover)), "item long, width int, seed long")
    asked = shared_checkpoint(asked)
    widths = [r["width"] for r in asked.select("width").distinct().collect()]  # SEED of them at most
    bit = F.col("bit") + 1
    words = asked.select("seed").mapInArrow(T.tidy(_bit_rows(bits)), "bit long").select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at"))
    words = words.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap")).collect()  # 2^BITS bits in all
    shared = spark.sparkContext.broadcast([(r["bucket"] - 1, bytes(r["bitmap"])) for r in words])

    near = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(T.tidy(_found_seeds(shared, widths, bits)), "doc_id long, text string, seeds array<long>")
    near = shared_checkpoint(near.withColumn("row", F.monotonically_increasing_id()))
    salted = asked.select("seed", "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = near.select("row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("seeds").alias("seed"))
    pairs = found.join(salted, ["seed", "salt"]).select("row", "item").distinct()
    theirs = pairs.join(items, "item").select("row", F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.lit(None).cast("long").alias("print"), "text")
    ours = near.select("row", F.lit(0).alias("kind"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), "text")
    return ours.unionByName(theirs).repartition("row").sortWithinPartitions("row", "kind").mapInArrow(T.tidy(_laid(cover)), SCHEMA)


def contaminations(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, bits: int = BITS) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, coverage, tiles): a row for each row of ``docs`` and item that it contains.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Null or empty texts, and items
    without tokens, contain and contaminate nothing. An item of fewer than SEED tokens is contained wherever all of them
    stand in a row. Repeated rows give repeated results, repeated items one for each text; null ids are kept, and an empty
    table on either side gives none.
    """
    return _matched(docs, benchmark, cover, bits).drop("print")


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, …) that no item contaminates, with all their columns, whatever these are called.

    A row goes by its own text: others with its doc_id do not matter. Null and empty texts stay, as do all rows if the
    benchmark is empty.
    """
    found = shared_checkpoint(_matched(docs, benchmark, cover, BITS).select(F.struct("doc_id", "print").alias("_gone")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = F.struct(F.col("_row.doc_id").alias("doc_id"), F.xxhash64("_row.text").alias("print"))
    kept = rows.join(F.broadcast(found) if found.count() <= FEW else found, own.eqNullSafe(F.col("_gone")), "left_anti")
    return kept.select("_row.*")
