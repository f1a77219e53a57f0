"""Choosing labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(rows: DataFrame, label: str, limit: int, texts: DataFrame) -> list[tuple[str, object]]:
    """Up to ``limit`` (text, label) pairs, those with the least hash of their id: the same whatever the partitions.

    ``rows`` has doc_id and ``label``. Only ids are ranked; ``limit`` of them, a bound, are joined with the texts.
    """
    some = rows.groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = some.sparkSession.createDataFrame(some.collect(), some.schema)
    found = texts.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return [(r.text, r._label) for r in found.select("doc_id", "text", "_label").orderBy("doc_id", "text").collect()]
