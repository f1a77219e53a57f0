"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

All documents of a source expect the same number of copies r = target / size of the source. Along the source, in order of
size class and of a hash of doc_id and text, the expected copies are summed up; shifted by one offset of the source, a
document is taken once for each whole number its step crosses: floor(r) or ceil(r) times. Neighbours in that order have
about the same size, so the words taken come near the target as well.

Texts are read once, for size and hash; all else is reckoned on these few bytes a document. A document's place is the count
before it within (source, size class, range of the hash) plus the counts of the cells before: ranges hold about BLOCK
documents, however ids are spread, so no source is numbered in one task. Rows with one doc_id, source and text are one
place with a count, as any of them may stand for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import stable_hash
from strandline.sources.shared import shared_checkpoint

BLOCK = 16_384
HASH_BITS = 60


def _mark(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text; null is told from empty."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("#"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mark, size, n): a row for all rows with one doc_id, source and text."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = docs.select("doc_id", "source", _mark(F.col("doc_id"), F.col("text")).alias("mark"), size.alias("size"))
    return shared_checkpoint(each.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("n")))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, limit: int, seed: int) -> DataFrame:
    """(source, k, source_size, target, u): one row for each source; the windows see only these rows.

    Where the sources with the least size / weight reach ``limit`` times their size, the level of the others is what is
    left over their weights. That level rises while a source is over its limit and falls afterwards: the greatest counts.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    each = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("k", F.row_number().over(by))
    each = each.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * limit
    level = (F.sum("source_size").over(everything) * F.lit(share) - full) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    each = each.withColumn("level", level).withColumn("top", F.max("level").over(everything))
    target = F.least(F.col("source_size") * F.lit(float(limit)), F.col("top") * F.col("w"))
    offset = F.pmod(stable_hash("k", seed), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return each.select("source", "k", "source_size", target.alias("target"), offset.alias("u"))


def placed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, mark, size, n, source_size, target, r, u, before): ``before`` counts the source's rows that come first."""
    sized = _sized(docs)
    targets = source_targets(sized, weights, share, limit, seed)
    # as many ranges of the hash as make cells of about ``block`` rows; where they end changes no place
    bits = max(0, (sized.count() // block).bit_length())
    digits = F.col("size").cast("string")
    tier = F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")
    known = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    known = known.withColumn("tier", tier).withColumn("range", F.shiftright("mark", HASH_BITS - bits))
    cell = ["k", "tier", "range"]
    first = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = known.groupBy(*cell).agg(F.sum("n").alias("_n"))
    ranges = counts.withColumn("_in", F.coalesce(F.sum("_n").over(first(*cell)), F.lit(0))).drop("_n")
    tiers = counts.groupBy("k", "tier").agg(F.sum("_n").alias("_n"))
    tiers = tiers.withColumn("_below", F.coalesce(F.sum("_n").over(first("k", "tier")), F.lit(0))).drop("_n")
    own = Window.partitionBy(*cell).orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = known.withColumn("_own", F.coalesce(F.sum("n").over(own), F.lit(0)))
    out = ranked.join(ranges.join(tiers, ["k", "tier"]), cell).withColumn("before", F.col("_own") + F.col("_in") + F.col("_below"))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("doc_id", "source", "mark", "size", "n", "source_size", "target", r.alias("r"), "u", "before")


def _copies(place: Column) -> Column:
    """How often the row at ``place`` (from 1) of its source is taken."""
    at = place.cast("double")
    return (F.floor(F.col("r") * at + F.col("u")) - F.floor(F.col("r") * (at - 1) + F.col("u"))).cast("long")


def plan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of each row of ``docs`` (doc_id, source, text, …).

    size counts the words of the text (null: 0), also in ``source_size``; a null source is a source of its own, last in
    order. Empty texts get copies too and take no words. Rows that repeat a doc_id are documents of their own, also with
    null ids; an empty table gives none. The same rows give the same copies however they are partitioned.
    """
    each = placed(docs, **options).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = each.withColumn("copies", _copies(F.col("before") + F.col("_i")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns, whatever these are called.

    Odd rows as in ``plan``. Texts are shuffled once, to meet their place; rows that repeat a doc_id, source and text are
    numbered within that key in the same step.
    """
    places = placed(docs, **options).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), "r", "u", "before", "n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumns({"_m": _mark(F.col("_row.doc_id"), F.col("_row.text")), "_s": F.col("_row.source"), "_d": F.col("_row.doc_id")})
    met = rows.join(places, (F.col("_m") == F.col("_mark")) & F.col("_s").eqNullSafe(F.col("_source")) & F.col("_d").eqNullSafe(F.col("_id")))
    once = met.where("n = 1").withColumn("_i", F.lit(1))
    again = met.where("n > 1").withColumn("_i", F.row_number().over(Window.partitionBy("_mark", "_source", "_id").orderBy(F.lit(0))))
    out = once.unionByName(again).withColumn("_copies", _copies(F.col("before") + F.col("_i"))).where("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x'||substr(md5(coalesce(doc_id::VARCHAR,'null')||'#'||coalesce(md5(text),'null')),1,15))::BIGINT AS mark FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source),
  w AS (SELECT *, [3, 1, 2][((k - 1) % 3 + 1)::INT] AS w FROM s),
  l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER b, 0)::DOUBLE * 2)
      / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level FROM w
    WINDOW b AS (ORDER BY source_size::DOUBLE / w::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT source, k, source_size, least(source_size * 2.0::DOUBLE, (SELECT max(level) FROM l) * w) AS target,
      (('0x'||substr(md5(k||'#17'),1,15))::BIGINT % 1048576)::DOUBLE / 1048576.0::DOUBLE AS u FROM l),
  p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END::DOUBLE AS r,
      (row_number() OVER (PARTITION BY t.k ORDER BY length(d.size::VARCHAR) * 100 + substr(d.size::VARCHAR,1,2)::INT, d.mark, d.doc_id, d.size))::DOUBLE AS n
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size, source_size, target, ((floor(r * n + u) - floor(r * (n - 1) + u))::BIGINT * size)::BIGINT AS taken FROM p"""
