"""Suffix arrays: per short record in place, for long texts by prefix doubling, and per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import shared_checkpoint

#: A record is sorted in place only up to this many characters: suffix copies take the square of it.
IN_PLACE = 2_000


def _sorted_positions(text: Column) -> Column:
    """Positions in suffix order. Plain byte order, a prefix before its extensions."""
    every = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.struct(F.substring(text, i + 1, F.length(text)).alias("s"), i.cast("long").alias("pos")))
    return F.when(F.length(text) > 0, F.transform(F.array_sort(every), lambda x: x["pos"])).otherwise(F.array().cast("array<long>"))


def short_suffix_arrays(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, pos) of records of bounded length; no shuffle."""
    return texts.where(F.length(text) > 0).select(key, F.posexplode(_sorted_positions(F.col(text))).alias("rank", "pos")).withColumn("rank", F.col("rank").cast("long"))


def _dense(frame: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Rank of ``order`` within each text as the number of smaller rows plus one.

    Rows are range-partitioned by (key, order), numbered inside each partition, and shifted by the counts of the
    partitions before; only those counts (one row for each partition and text) meet in a window.
    """
    placed = shared_checkpoint(frame.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.rank().over(Window.partitionBy("_part", key).orderBy(*order))
    return placed.withColumn("_local", local).join(before.drop("_n"), [key, "_part"]).withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", "_part")


def long_suffix_arrays(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, pos) by prefix doubling: about log2(longest repeat) rounds, each a join on positions.

    Ranges keep equal keys in one partition, so a rank of ties is exact. Missing successors rank lowest: a suffix that
    ends sorts before its extensions.
    """
    chars = texts.where(F.length(text) > 0).select(key, F.posexplode(F.split(F.col(text), "")).alias("pos", "c")).where("c <> ''").withColumn("pos", F.col("pos").cast("long"))
    ranked = shared_checkpoint(_dense(chars, key, ["c"], "r").select(key, "pos", "r"))
    h = 1
    while True:
        ahead = ranked.select(key, (F.col("pos") - h).alias("pos"), F.col("r").alias("r2"))
        pairs = ranked.join(ahead, [key, "pos"], "left").withColumn("r2", F.coalesce("r2", F.lit(-1).cast("long")))
        ranked = shared_checkpoint(_dense(pairs, key, ["r", "r2"], "q").select(key, "pos", F.col("q").alias("r")))
        if ranked.groupBy(key, "r").count().where("count > 1").isEmpty():
            return ranked.select(key, (F.col("r") - 1).alias("rank"), "pos")
        h *= 2


def suffix_arrays(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, pos), rank from 0. Short records in place, longer ones by doubling."""
    short = short_suffix_arrays(texts.where(F.length(text) <= IN_PLACE), key, text)
    far = texts.where(F.length(text) > IN_PLACE)
    return short if far.isEmpty() else short.unionByName(long_suffix_arrays(far, key, text))


def chunk_suffix_arrays(texts: DataFrame, key: str, text: str, chunk: int = 1_000_000) -> DataFrame:
    """(key, chunk_id, start_pos, rank, pos): an array for each chunk, positions from the chunk's start, never merged."""
    parts = texts.where(F.length(text) > 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"(length(`{text}`) - 1) div {chunk}")), lambda i: F.struct(i.alias("chunk_id"), F.substring(F.col(text), (i * chunk + 1).cast("int"), F.lit(chunk)).alias("piece")))).alias("x"))
    named = parts.select(F.struct(key, F.col("x.chunk_id").alias("chunk_id")).alias("at"), F.col("x.piece").alias("piece"))
    return suffix_arrays(named, "at", "piece").select(F.col(f"at.{key}").alias(key), F.col("at.chunk_id").cast("long").alias("chunk_id"), (F.col("at.chunk_id") * chunk).cast("long").alias("start_pos"), "rank", "pos")


def first_suffixes(texts: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """The first ``n`` entries of each array: a short record's array is cut before it becomes rows."""
    near = texts.where((F.length(text) > 0) & (F.length(text) <= IN_PLACE))
    short = near.select(key, F.posexplode(F.slice(_sorted_positions(F.col(text)), 1, n)).alias("rank", "pos")).withColumn("rank", F.col("rank").cast("long"))
    far = texts.where(F.length(text) > IN_PLACE)
    return short if far.isEmpty() else short.unionByName(long_suffix_arrays(far, key, text).where(F.col("rank") < n))
