"""Nearest neighbours by cosine from a few stable projections and kd-trees.

Unit vectors are projected on DIMS normal directions (a 2-stable law): a squared distance s becomes s times a chi-square
variable. Cuts of a kd-tree over projections of a bounded sample deal all vectors to regions; a region that holds more
than CELL is split by a hash, and queries stream past a cell, so a task holds a bounded number of vectors. Each cell has a
kd-tree of its own.

In a cell a query takes its FIRST nearest vectors by projected distance and verifies them exactly. Then it goes on outwards,
and stops where a vector, were it nearer than the k-th found, would have been projected only with probability 1 - SURE
(chi-square test); leaves that begin farther out are not opened. Queries of a batch that lie together do so together, as
products of matrices. The first round searches the query's own region; its k-th distance tells by the same test which other
cells a query goes to in the second.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources.shared import importable, shared_checkpoint

DIMS, LEAF, CELL, SAMPLE, SURE = 12, 64, 4_096, 20_000, 0.95
#: Projected neighbours verified first, and queries taken together.
FIRST, TOGETHER = 128, 64
#: The squared distance reached by a query that has found too few: nothing is too far for it.
ANY = float("inf")


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of dimensions."""
    half, term, total = x / 2, 1.0, 0.0
    for j in range(dims // 2):
        total += term
        term *= half / (j + 1)
    return 1 - math.exp(-half) * total


def chi_square_bound(sure: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < sure else (low, mid)
    return high


def directions(width: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, DIMS))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component to about 1: exact, and no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def region_cuts(points: np.ndarray, regions: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as (dimension, cut, left, right); a negative child -r - 1 is region r. Equal points stay together."""
    nodes: list[tuple[int, float, int, int]] = []
    names = iter(range(1 << 30))

    def grow(p: np.ndarray, n: int) -> int:
        spread = p.max(0) - p.min(0) if len(p) else np.zeros(DIMS)
        dim = int(spread.argmax())
        if n < 2 or len(p) < 2 or not spread[dim] > 0:
            return -next(names) - 1
        cut = float(np.median(p[:, dim]))
        if not (p[:, dim] < cut).any():
            cut = float(p[p[:, dim] > cut, dim].min())
        at = len(nodes)
        nodes.append((dim, cut, 0, 0))
        less = p[:, dim] < cut
        nodes[at] = (dim, cut, grow(p[less], n // 2), grow(p[~less], n - n // 2))
        return at

    root = grow(points, regions)
    return nodes if root >= 0 else []


def place(points: np.ndarray, cuts: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def go(at: int, rows: np.ndarray) -> None:
        if at < 0:
            out[rows] = -at - 1
            return
        dim, cut, left, right = cuts[at]
        less = points[rows, dim] < cut
        go(left, rows[less])
        go(right, rows[~less])

    if cuts and len(points):
        go(0, np.arange(len(points)))
    return out


def boxes(cuts: list[tuple[int, float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the regions, open ones infinite."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def go(at: int, low: np.ndarray, high: np.ndarray) -> None:
        if at < 0:
            found[-at - 1] = (low, high)
            return
        dim, cut, left, right = cuts[at]
        a, b = high.copy(), low.copy()
        a[dim] = b[dim] = cut
        go(left, low, a)
        go(right, b, high)

    go(0 if cuts else -1, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))
    return np.stack([found[r][0] for r in range(len(found))]), np.stack([found[r][1] for r in range(len(found))])


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each point to each box."""
    d = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (d * d).sum(2)


class Cell:
    """Vectors of one cell in a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        points = units(vectors) @ directions(vectors.shape[1])
        leaf = place(points, region_cuts(points, -(-len(ids) // LEAF)))
        order = np.argsort(leaf, kind="stable")
        bounds = np.searchsorted(leaf[order], np.arange(leaf.max() + 2))
        self.sizes = np.diff(bounds)[np.diff(bounds) > 0]
        ends = np.cumsum(self.sizes)
        self.points = points[order]
        self.low = np.stack([self.points[a:b].min(0) for a, b in zip(ends - self.sizes, ends, strict=True)])
        self.high = np.stack([self.points[a:b].max(0) for a, b in zip(ends - self.sizes, ends, strict=True)])
        self.ids, self.copies, self.vectors = ids[order], copies[order], scaled(vectors[order])
        self.norm = np.sqrt((self.vectors * self.vectors).sum(1))
        self.verified = 0

    def _scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines with one query; equal vectors give equal scores."""
        return (self.vectors[rows] * query).sum(-1) / (self.norm[rows] * np.sqrt((query * query).sum()))

    def search(self, queries: np.ndarray, reach: np.ndarray, k: int, sure: float = SURE) -> list[tuple[int, int, float]]:
        """(row of the query, row of the cell, score): up to ``k`` best for each. reach: squared distances already reached."""
        queries, asked = scaled(queries), units(queries) @ directions(queries.shape[1])
        limit, out = chi_square_bound(sure, DIMS), []
        order = np.lexsort(asked.T)
        for at in range(0, len(order), TOGETHER):
            out += self._together(order[at : at + TOGETHER], queries, asked, reach, k, limit)
        return sorted(out, key=lambda x: x[0])

    def _together(self, rows: np.ndarray, queries: np.ndarray, asked: np.ndarray, reach: np.ndarray, k: int, limit: float) -> list[tuple[int, int, float]]:
        q, p, least = queries[rows], asked[rows], reach[rows].copy()
        norm = np.sqrt((q * q).sum(1))
        far = gaps(p, self.low, self.high)
        near = (p * p).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * p @ self.points.T
        n = len(self.ids)
        if k <= n:
            first = np.argpartition(near, min(FIRST, n) - 1, 1)[:, : max(min(FIRST, n), k)] if n > k else np.tile(np.arange(n), (len(rows), 1))
            scores = np.einsum("qid,qd->qi", self.vectors[first], q) / (self.norm[first] * norm[:, None])
            kth = -np.partition(-scores, k - 1, 1)[:, k - 1] if scores.shape[1] >= k else np.full(len(rows), -1.0)
            least = np.minimum(least, np.maximum(2 - 2 * kth, 0) + 1e-9)
        open_ = np.flatnonzero(np.repeat((far <= limit * least[:, None]).any(0), self.sizes))
        within = near[:, open_] <= limit * least[:, None] + 1e-9
        self.verified += int(within.sum())
        scores = np.where(within, q @ self.vectors[open_].T / (self.norm[open_] * norm[:, None]), -2.0)
        out = []
        for i, row in enumerate(rows.tolist()):
            own = scores[i]
            bar = -np.partition(-own, k - 1)[k - 1] if len(own) > k else -1.5
            some = open_[np.flatnonzero(own >= max(bar - 1e-9, -1.5))]
            exact = self._scores(q[i], some)
            top = np.lexsort((self.ids[some], -exact))[:k]
            out += zip([row] * len(top), some[top].tolist(), exact[top].tolist(), strict=True)
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _placed(rows: DataFrame, cuts: list[tuple[int, float, int, int]], width: int, schema: str) -> DataFrame:
    """``rows`` with v, and the region of each, in the shared folder."""
    def run(stream):
        for batch in stream:
            if batch.num_rows:
                m = _matrix(batch.column("v"), width)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place(units(m) @ directions(width), cuts))], [*batch.schema.names, "region"])

    return shared_checkpoint(rows.mapInArrow(run, f"{schema}, region long"))


def _look(width: int, want: int):
    """Rows sorted by (region, salt, kind) to what each query (kind 1) finds among the vectors (kind 0) of its cell.

    Only one cell's vectors are held, a bounded number; queries go past in batches, however many a cell gets.
    """
    def run(stream):
        at, held, cell = None, [], None
        for batch in stream:
            if not batch.num_rows:
                continue
            region, salt, kind = (batch.column(c).to_numpy() for c in ("region", "salt", "kind"))
            new = np.flatnonzero((region[1:] != region[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if (region[a], salt[a]) != at:
                    at, held, cell = (region[a], salt[a]), [], None
                part = batch.slice(a, b - a)
                ids, m = part.column("id").to_numpy(), _matrix(part.column("v"), width)
                if kind[a] == 0:
                    held.append((ids, part.column("copies").to_numpy(), m))
                elif held:
                    cell = cell or Cell(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    found = cell.search(m, part.column("reach").to_numpy(), want)
                    q, i, score = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(cell.ids[i]), pa.array(cell.copies[i]), pa.array(score, pa.float64())], ["asker", "vec_id", "copies", "score"])

    return run


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each vector whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding; other columns are ignored. Rows take no part if vec_id or embedding is null, a
    component is null or not finite, or all are zero; finite components may be of any size. Vectors of another width have no
    cosine with a query: each width is searched by itself. A row never finds its own vec_id; rows that repeat
    another vec_id count once for each row, and repeated query rows are answered once,
    those with one vec_id and several vectors for each vector. Ties go to the smaller vec_id.
    Scores are cosines in double precision. Only the sample, the cuts and a count for each region reach the driver.

    Equal vectors score alike. So of those only the k + 1 smallest vec_ids are candidates, which is all that any query can
    take of them, and equal queries are searched once.
    """
    spark = importable(vectors.sparkSession)
    item = vectors.schema["embedding"].dataType.elementType
    item = "float" if isinstance(item, T.FloatType) else "double"  # in four bytes where that is how they came
    doubles = F.transform("v", lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    good = vectors.select("vec_id", F.col("embedding").cast(f"array<{item}>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in good.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy("w").collect():  # a row for each width
        out = out.unionByName(_of_width(good.where(F.size("v") == r["w"]), r["w"], r["n"], item, k, every))
    return out


def _of_width(good: DataFrame, width: int, n: int, item: str, k: int, every: int) -> DataFrame:
    """``neighbours`` among the ``n`` sound vectors v of one width."""
    sample = good.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    cuts = region_cuts(units(np.stack([np.asarray(x, np.float64) for x in sample["v"]])) @ directions(width), -(-n // CELL))

    # dense_rank: map tasks send no more than k + 1 ids of a vector; the aggregate keeps that partitioning
    low = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = good.withColumn("low", low).where(F.col("low") <= k + 1).groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    placed = _placed(few.select("vec_id", "copies", "v"), cuts, width, f"vec_id long, copies long, v array<{item}>")
    sizes = {r["region"]: max(1, -(-r["n"] // CELL)) for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    salt = lambda name: F.pmod(F.xxhash64(name, "v"), F.coalesce(cells[F.col("region")], F.lit(1))).cast("int").alias("salt")
    data = placed.select("region", salt("vec_id"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "copies", "v", F.lit(0.0).alias("reach"))

    askers = shared_checkpoint(good.where(F.col("vec_id") % every == 0).distinct())
    own = askers.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    want = k + own  # a query's own id, mostly once, is left out of what is found
    classes = _placed(askers.groupBy("v").agg(F.min("vec_id").alias("first")).select(F.xxhash64("v", "first").alias("asker"), "v"), cuts, width, f"asker long, v array<{item}>")

    def probed(queries: DataFrame) -> DataFrame:
        asked = queries.select("region", "salt", F.lit(1).alias("kind"), F.col("asker").alias("id"), F.lit(0).cast("long").alias("copies"), "v", F.col("kth").alias("reach"))
        rows = data.unionByName(asked).repartition("region", "salt").sortWithinPartitions("region", "salt", "kind")
        return rows.mapInArrow(_look(width, want), "asker long, vec_id long, copies long, score double")

    home = classes.select("region", salt("asker"), "asker", "v", F.lit(ANY).alias("kth"))
    reached = probed(home).groupBy("asker").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    kth = reached.select("asker", F.when(F.col("n") >= want, F.greatest(2 - 2 * F.col("s"), F.lit(0.0)) + 1e-12).otherwise(ANY).alias("kth"))

    def route(stream):
        low, high = boxes(cuts)
        limit = chi_square_bound(SURE, DIMS)
        for batch in stream:
            if not batch.num_rows:
                continue
            near = gaps(units(_matrix(batch.column("v"), width)) @ directions(width), low, high) <= limit * batch.column("kth").to_numpy()[:, None]
            rows, regions = np.nonzero(near)
            goes = [(i, r, s) for i, r in zip(rows.tolist(), regions.tolist(), strict=True) for s in range(sizes.get(r, 0))]
            if goes:
                i, r, s = (list(x) for x in zip(*goes, strict=True))
                picked = batch.select(["asker", "v", "kth"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int32()), *picked.columns], ["region", "salt", "asker", "v", "kth"])

    far = classes.join(kth, "asker", "left").select("asker", "v", F.coalesce("kth", F.lit(ANY)).alias("kth"))
    routed = far.mapInArrow(route, f"region long, salt int, asker long, v array<{item}>, kth double")
    best = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    top = probed(routed).withColumn("at", best).where(F.col("at") <= want)
    lists = top.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "copies", "score"))).alias("found"))
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    rows = F.flatten(F.transform(others, lambda x: F.array_repeat(F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")), F.least(x["copies"], F.lit(k)).cast("int"))))
    answered = askers.join(classes.select("asker", "v"), "v").select(F.col("vec_id").alias("query_id"), "asker").join(lists, "asker")
    return answered.select("query_id", F.posexplode(F.slice(rows, 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
