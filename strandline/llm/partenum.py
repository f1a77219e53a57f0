"""Jaccard self-join of documents by PartEnum signatures.

Sets are word shingles. For sizes L <= a < L' (a band) and partners b up to a / threshold, a link means a symmetric
difference of at most k features. The feature domain is dealt by hash into n1 parts of n2 cells each; a link leaves some
part with at most k2 differing features, hence some choice of n2 - k2 of its cells without any. One signature stands for
each choice: its band, part, choice, and the sum of the hashes of its features.

Parts are n1 = k // (k2 + 1) + 1 + spare. At least 1 + spare parts hold an equal choice, so a set may leave out choices
without features, which would meet by chance, as long as no more than ``spare`` of its parts have one; else it gives
them too. No link is lost in either case.

Equal signatures only name candidates. Groups that share their members are taken once. Within a group, sketches of the
sets are compared: counts of the features by hash cell, whose distance is at most the symmetric difference. Cells grow with the set, as
else long texts without a link would look alike; of two sketches the finer is folded. A search visits
a set's possible links among all sets not yet reached, so that whatever may be linked stays connected, and pairs are never
listed. Components of what remains are verified on the sets themselves by the same search. Both searches work in blocks of
bounded size, and larger groups in pairs of blocks. Hence all links between different texts count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbuf as T
from strandline.llm.components import components
from strandline.sources.shared import importable, shared_checkpoint

U = np.uint64
#: A verified block holds at most about this many sets and features.
BLOCK_SETS, BLOCK_FEATURES = 512, 400_000
#: Sets of a group compared by sketch at once. A sketch has CELLS cells, or as many more (a power of two) as leave FILL
#: features or fewer to a cell; up to MOST_CELLS, as a block must fit in memory. Sets with more than about 25 features a
#: cell are no longer told apart by it, which costs time but no link. A count stops at 255, which only shortens distances.
BLOCK_SKETCHES, CELLS, FILL, MOST_CELLS = 4_096, 128, 8, 16_384
#: Members of a group up to which it gets a name from its members.
NAMED = 100_000


@cache
def bands(percent: int, upto: int) -> list[tuple[int, int, int, int]]:
    """(L, last smaller size, largest partner, k) until sizes reach ``upto``."""
    out, low = [], 1
    while low <= upto:
        after = low * 100 // percent + 1
        top = (after - 1) * 100 // percent
        out.append((low, after - 1, top, (after - 1 + top) * (100 - percent) // (100 + percent)))
        low = after
    return out


@cache
def layout(low: int, k: int, n2: int, k2: int) -> tuple[int, int]:
    """(n1, spare) of a band: spare covers what a set of the least size is expected to leave empty, with a margin."""
    spare = 0
    while True:
        n1 = k // (k2 + 1) + 1 + spare
        empty = n1 * math.comb(n2, k2) * math.exp(-low * (n2 - k2) / (n1 * n2))
        if spare >= min(empty + 3 * math.sqrt(empty) + 0.5, n1 / 2) or spare > 200 + k:
            return n1, spare
        spare += 1


def signatures(features: np.ndarray, percent: int, n2: int = 2, k2: int = 1) -> np.ndarray:
    """All signatures of one set of distinct hashes. Bands with k = 0 only link equal sets and give none."""
    size, out = len(features), []
    for at, (low, _, top, k) in enumerate(bands(percent, 2 * size)):
        if not (low <= size <= top and k):
            continue
        n1, spare = layout(low, k, n2, k2)
        m = T.mix(features ^ U(at * 2 + 1))
        cell = (((m >> U(32)) * U(n1 * n2)) >> U(32)).astype(np.int64)
        cells = n1 * n2
        count = np.bincount(cell, minlength=cells).reshape(n1, n2)
        # two exact float sums of 32-bit halves in place of a scatter-add of 64-bit words
        low_sum = np.bincount(cell, (m & U(0xFFFFFFFF)).astype(np.float64), cells).reshape(n1, n2)
        high_sum = np.bincount(cell, (m >> U(32)).astype(np.float64), cells).reshape(n1, n2)
        picks = list(combinations(range(n2), n2 - k2))
        counts = np.stack([count[:, p].sum(1) for p in picks], 1)
        lows = np.stack([low_sum[:, p].sum(1) for p in picks], 1).astype(np.uint64)
        highs = np.stack([high_sum[:, p].sum(1) for p in picks], 1).astype(np.uint64)
        name = (np.arange(n1 * len(picks), dtype=np.uint64).reshape(n1, -1) + U(1)) * U(0xA0761D6478BD642F) + U((at + 1) * 0xE7037ED1A0B428DB % (1 << 64))
        sig = T.mix(T.mix(lows + (highs << U(32)) + (highs >> U(32)) * U(0x8EBC6AF09C88C6E3)) + name)
        keep = (counts > 0) | ((counts == 0).any(1).sum() > spare)
        out.append(sig[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    start, end, first = T.words(data, offsets)
    h, bounds = T.shingle_hashes(T.word_hashes(data, start, end), first, width)
    for d in range(len(offsets) - 1):
        yield np.unique(h[bounds[d] : bounds[d + 1]])


def set_id(features: np.ndarray) -> int:
    """A 63-bit name for a set."""
    return int(T.mix(np.array([T.mix(features).sum() + U(len(features))], np.uint64))[0] >> U(1))


def sketch(features: np.ndarray) -> np.ndarray:
    cells = min(max(CELLS, 1 << max(-(-len(features) // FILL) - 1, 0).bit_length()), MOST_CELLS)
    return np.minimum(np.bincount((features >> U(65 - cells.bit_length())).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def folded(sketches: np.ndarray, cells: int) -> np.ndarray:
    """Sketches (in the last axis) of as many or more cells, as ones of ``cells``."""
    if sketches.shape[-1] == cells:
        return sketches
    return np.minimum(sketches.reshape(*sketches.shape[:-1], cells, -1).sum(-1, dtype=np.int64), 255).astype(np.uint8)


def _name_sets(width: int):
    def run(stream):
        for rows, data, at in T.batches(stream):
            sets = [(len(s), set_id(s) if len(s) else None, sketch(T.mix(s)).tobytes() if len(s) else None) for s in shingle_sets(data, at, width)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("mark"), *[pa.array([x[i] for x in sets], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "mark", "n_shingles", "set_id", "sketch"])

    return run


def _sign_sets(width: int, percent: int, n2: int, k2: int):
    def run(stream):
        given: set[int] = set()  # sets of this task that are signed already: copies send nothing more
        for _, data, at in T.batches(stream):
            sigs, ids = [], []
            for s in shingle_sets(data, at, width):
                if len(s) and (name := set_id(s)) not in given:
                    given.add(name)
                    sigs.append(signatures(s, percent, n2, k2))
                    ids.append(np.full(len(sigs[-1]), name, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "set_id"])

    return run


def _groups(stream):
    """Rows sorted by (sig, set_id) to (group, set_id) of signatures that several sets have.

    A group is named by its members, so that those of many signatures fall together; one of more than NAMED members is
    named by its signature and goes out as it comes.
    """
    held: list[np.ndarray] = []  # members of the last signature, which may go on
    sig0, count, loose = None, 0, False

    def packed(group: np.ndarray, ids: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(ids)], ["grp", "set_id"])

    def close():
        if loose or count < 2:
            return None
        ids = np.unique(np.concatenate(held))
        if len(ids) < 2:
            return None
        return packed(np.full(len(ids), T.mix(ids.astype(U)).sum(), U), ids)

    for batch in stream:
        if not batch.num_rows:
            continue
        sig, ids = (batch.column(c).to_numpy() for c in ("sig", "set_id"))
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])  # copies signed by several tasks
        sig, ids = sig[fresh], ids[fresh]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        if sig0 is not None and sig[0] == sig0:
            stop = starts[1] if len(starts) > 1 else len(sig)
            if loose:
                yield packed(np.full(stop, T.mix(np.array([sig0]).astype(U))[0], U), ids[:stop])
            else:
                held.append(ids[:stop])
                count += stop
            starts = starts[1:]
        if len(starts):
            if (last := close()) is not None:
                yield last
            final = starts[-1]
            sizes = np.diff(starts)
            sums = np.add.reduceat(T.mix(ids[:final].astype(U)), starts[:-1]) if final and len(starts) > 1 else np.zeros(0, U)
            if final and len(starts) > 1:
                begin = starts[0]
                many = np.repeat(sizes > 1, sizes)
                if many.any():
                    rows = np.unique(np.stack([np.repeat(sums, sizes)[many].view(np.int64), ids[begin:final][many]], 1), axis=0)
                    yield packed(np.ascontiguousarray(rows[:, 0]).view(U), np.ascontiguousarray(rows[:, 1]))
            sig0, held, count, loose = sig[-1], [ids[final:]], len(ids) - final, False
        if count > NAMED and not loose:
            ids = np.concatenate(held)
            yield packed(np.full(len(ids), T.mix(np.array([sig0]).astype(U))[0], U), ids)
            held, loose = [], True
    if (last := close()) is not None:
        yield last


def in_groups(stream, keys: list[str]):
    """Arrow tables of the rows with equal ``keys``; the stream must be sorted by them."""
    rest = None
    for batch in stream:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1]).combine_chunks()
    if rest is not None:
        yield rest


class Sketches:
    """Sketches of several sizes, those of one size in one array."""

    def __init__(self, raw: list[bytes]):
        self.cells = np.array([len(r) for r in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.arrays: dict[tuple[int, int], np.ndarray] = {}
        for c in np.unique(self.cells).tolist():
            at = np.flatnonzero(self.cells == c)
            self.place[at] = np.arange(len(at))
            self.arrays[c, c] = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(-1, c)

    def _at(self, own: int, cells: int) -> np.ndarray:
        if (own, cells) not in self.arrays:
            self.arrays[own, cells] = folded(self.arrays[own, own], cells)
        return self.arrays[own, cells]

    def distances(self, p: int, others: np.ndarray) -> np.ndarray:
        """From sketch ``p``, in the cells of the coarser of both."""
        out, own = np.zeros(len(others), np.int64), int(self.cells[p])
        theirs = self.cells[others]
        for c in np.unique(theirs).tolist():
            at = np.flatnonzero(theirs == c)
            both = min(own, c)
            mine, rows = self._at(own, both)[self.place[p]], self._at(c, both)[self.place[others[at]]]
            out[at] = (np.maximum(rows, mine) - np.minimum(rows, mine)).sum(1, dtype=np.int64)
        return out


def sketch_forest(ids: np.ndarray, sizes: np.ndarray, sketches: Sketches, percent: int) -> list[tuple[int, int]]:
    """Edges that connect all sets whose sizes and sketches allow a link, directly or through others."""
    left, out, queue = np.arange(len(ids)), [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            if not len(left):
                break
        p = queue.pop()
        fit = left[(100 * np.minimum(sizes[left], sizes[p]) >= percent * np.maximum(sizes[left], sizes[p]))]
        if not len(fit):
            continue
        found = fit[(100 + percent) * sketches.distances(p, fit) <= (100 - percent) * (sizes[fit] + sizes[p])]
        if len(found):
            out += [(int(ids[p]), int(ids[i])) for i in found]
            queue += found.tolist()
            left = np.setdiff1d(left, found, assume_unique=True)
    return out


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def _searched(keys: list[str], search):
    """``search(table)`` of each group, its edges in batches."""
    def run(stream):
        out: list[tuple[int, int]] = []
        for table in in_groups(stream, keys):
            if table.num_rows > 1:
                out += search(table)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _by_sketch(percent: int):
    def search(table: pa.Table) -> list[tuple[int, int]]:
        sketches = Sketches(table.column("sketch").to_pylist())
        return sketch_forest(table.column("set_id").to_numpy(), table.column("n").to_numpy(), sketches, percent)

    return search


def _by_features(percent: int):
    def search(table: pa.Table) -> list[tuple[int, int]]:
        lists = table.column("features").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        return linked_forest(table.column("set_id").to_numpy(), [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], percent)

    return search


def _in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """Rows with (group, x, y): all of a group together if it has one part, else each pair of its parts."""
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0))), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    pairs = F.filter(others, lambda p: (F.col("parts") == 1) | (p["x"] < p["y"]))
    keep = [c for c in rows.columns if c != "parts"]
    return rows.withColumn("own", own).select(*keep, F.inline(pairs)).repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "set_id")


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span all links among ``sets``: whatever is linked stays connected.

    Each visited set is compared with every set not reached yet, so nothing is skipped but links inside one component.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    left = np.arange(len(sets))
    out = []
    queue: list[int] = []
    live, live_starts, kept, built = flat, starts, left, len(left)
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            if not len(left):
                break
        p = queue.pop()
        own = flat[starts[p] : starts[p] + sizes[p]]
        mark[own] = 1
        if built > 2 * len(left):  # few are left: gather their features anew
            live, kept, built = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in left]), left, len(left)
            live_starts = np.concatenate([[0], np.cumsum(sizes[kept])[:-1]])
        common = np.add.reduceat(mark[live], live_starts)[np.searchsorted(kept, left)]
        mark[own] = 0
        hit = 100 * common >= percent * (sizes[p] + sizes[left] - common)
        found = left[hit]
        out += [(int(ids[p]), int(ids[i])) for i in found]
        queue += found.tolist()
        left = left[~hit]
    return out


def _features(width: int):
    def run(stream):
        for rows, data, at in T.batches(stream):
            sets = [s.view(np.int64) for s in shingle_sets(data, at, width)]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([rows.column("set_id"), rows.column("comp"), rows.column("parts"), lists], ["set_id", "comp", "parts", "features"])

    return run


def _classes(docs: DataFrame, percent: int, width: int, n2: int, k2: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, set_id) of each row of ``docs``, mark being a hash of its text, and (set_id, root, component_id)
    of each set that has a doc_id: root names its component."""
    importable(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
    named = shared_checkpoint(docs.mapInArrow(T.tidy(_name_sets(width)), "doc_id long, mark long, n_shingles long, set_id long, sketch binary"))
    texts = docs.where(F.col("doc_id").isNotNull())
    first = named.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    first = shared_checkpoint(first.select("set_id", F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("rep_mark"), "n", "sketch"))
    signed = texts.select("text").mapInArrow(T.tidy(_sign_sets(width, percent, n2, k2)), "sig long, set_id long")
    groups = signed.repartition("sig").sortWithinPartitions("sig", "set_id").mapInArrow(T.tidy(_groups), "grp long, set_id long").distinct()
    groups = shared_checkpoint(groups)
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SKETCHES).cast("int").alias("parts"))
    drawn = groups.join(sizes, "grp").join(first.select("set_id", "n", "sketch"), "set_id").select("grp", "set_id", "n", "sketch", "parts")
    possible = _in_blocks(drawn, "grp").mapInArrow(T.tidy(_searched(["grp", "x", "y"], _by_sketch(percent))), "a long, b long").distinct()
    near = shared_checkpoint(components(possible))

    sized = near.join(first.drop("sketch"), F.col("node") == F.col("set_id"))
    total = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_FEATURES)).cast("int").alias("parts"))
    asked = sized.join(total, "root").select(F.col("rep").alias("doc_id"), F.col("rep_mark").alias("mark"), "set_id", F.col("root").alias("comp"), "parts")
    sets = asked.join(texts, ["doc_id", "mark"]).select("set_id", "comp", "parts", "text").mapInArrow(T.tidy(_features(width)), "set_id long, comp long, parts int, features array<long>")
    links = _in_blocks(sets, "comp").mapInArrow(T.tidy(_searched(["comp", "x", "y"], _by_features(percent))), "a long, b long")
    return named.drop("sketch"), shared_checkpoint(_least(components(links), first))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, n2: int = 2, k2: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text, …).

    Links: 100 * common >= percent * union of the distinct ``width``-word shingles. component_id is the least doc_id that
    links reach, itself included. Texts without words are empty sets, linked with nothing. A row without doc_id keeps a
    null component_id and joins nothing; repeated rows come back as often. Rows with one doc_id and different texts are
    documents of their own, each with the component of its text. Other columns are ignored; an empty table gives none.
    """
    named, least = _classes(docs, percent, width, n2, k2)
    out = named.join(least.drop("root"), "set_id", "left")
    own_rep = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own_rep.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, n2: int = 2, k2: int = 1) -> DataFrame:
    """A row of ``docs`` (doc_id, text, …) for each class of linked texts, with all its columns, whatever these are called.

    It is the one with the least doc_id; if that has several texts in the class, the least by hash. Rows that repeat it
    count once, as do those with one doc_id and a text without words, which is a class of its own. Rows without doc_id are
    in no class and all stay.
    """
    named, least = _classes(docs, percent, width, n2, k2)
    known = named.where("doc_id is not null").join(least.select("set_id", "root"), "set_id", "left")
    chosen = known.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "set_id", "mark")).alias("x")).select("x.doc_id", "x.mark")
    kept = chosen.unionByName(known.where("root is null").select("doc_id", "mark")).select(F.struct("doc_id", "mark").alias("_kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = rows.where(F.col("_row.doc_id").isNotNull()).withColumn("_name", F.struct(F.col("_row.doc_id").alias("doc_id"), F.xxhash64("_row.text").alias("mark")))
    first = own.join(kept, F.col("_name") == F.col("_kept"), "left_semi").dropDuplicates(["_name"]).select("_row")
    return first.unionByName(rows.where(F.col("_row.doc_id").isNull())).select("_row.*")


def _least(joined: DataFrame, first: DataFrame) -> DataFrame:
    """(set_id, root, component_id) of every set: the least document of its component, or of its copies."""
    roots = first.join(joined, F.col("set_id") == F.col("node"), "left").select("set_id", "rep", F.coalesce("root", "set_id").alias("root"))
    low = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    return roots.join(low, "root").select("set_id", "root", "component_id")
