"""Bloom filters and MinHash signatures as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import stable_hash


def bloom_size(n_items: int) -> int:
    """Bits for ``n_items`` with three hashes."""
    return max(10 * n_items, 1_000_000)


def _slots(item: str, m: int, k: int):
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda seed: F.pmod(stable_hash(item, seed), F.lit(m)))


def bloom_bits(items: DataFrame, item: str, m: int = 50_000, k: int = 5) -> DataFrame:
    """(bit): the set bits. Partial distinct before the shuffle; insertion is idempotent, so retries are harmless."""
    return items.where(F.col(item).isNotNull()).select(F.explode(_slots(item, m, k)).alias("bit")).distinct()


def bloom_bitmap(bits: DataFrame) -> DataFrame:
    """(bucket, bitmap): set bits packed into 32,768-bit words; bit b is kept as b + 1, since positions start at 1."""
    return bits.select((F.col("bit") + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bitmap"))


def bloom_probe(items: DataFrame, key: str, item: str, bits: DataFrame, m: int = 50_000, k: int = 5) -> DataFrame:
    """(key, maybe): true for every inserted item, rarely for another one. At most m bits meet the probes."""
    probes = items.select(key, F.explode(F.array_distinct(_slots(item, m, k))).alias("bit"))
    found = probes.join(bits.withColumn("hit", F.lit(True)), "bit", "left")
    return found.groupBy(key).agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("maybe"))


def minhash(sets: DataFrame, key: str, item: str, n_hashes: int = 100) -> DataFrame:
    """(key, seed, min_hash): minima of each set, combined before the shuffle.

    Seeds become rows before they are aggregated: were they aggregates over the items, the optimiser would take a
    ``distinct`` below them for useless, and every repeat of an item would be hashed.
    """
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_hashes - 1).cast("long")), lambda s: F.struct(s.alias("seed"), stable_hash(item, s).alias("_h")))
    items = sets.where(F.col(item).isNotNull()).select(key, F.inline(hashes))
    return items.groupBy(key, "seed").agg(F.min("_h").alias("min_hash"))


def signature(mins: DataFrame, key: str) -> DataFrame:
    """(key, signature): minima in order of their seed."""
    return mins.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "min_hash"))), lambda x: x["min_hash"]).alias("signature"))


def first_minima(mins: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, signature): the first ``n`` minima of each signature; only those are gathered."""
    return signature(mins.where(F.col("seed") < n), key)


def jaccard(mins: DataFrame, key: str, others: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard): the share of equal minima, for the pairs of two tables of signatures, or a < b of one."""
    other = mins if others is None else others
    a = mins.select(F.col(key).alias("a"), "seed", F.col("min_hash").alias("ha"))
    b = other.select(F.col(key).alias("b"), "seed", F.col("min_hash").alias("hb"))
    pairs = a.join(b, "seed")
    pairs = pairs.where("a < b") if others is None else pairs
    return pairs.groupBy("a", "b").agg(F.avg((F.col("ha") == F.col("hb")).cast("double")).alias("jaccard"))
