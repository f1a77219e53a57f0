"""Generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import stable_hash


def random_dna(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    """(read_id, seq): bases picked by a seeded hash, so reruns and retries agree."""
    base = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.col("read_id"), i, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1))
    return spark.range(n).select(F.col("id").alias("read_id")).withColumn("seq", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), ""))


def expression_matrix(spark: SparkSession, rows: int = 100, columns: int = 10_000, seed: int = 0) -> DataFrame:
    """(row, features, label): values in [0, 10) in one array, label 0 or 1."""
    unit = lambda i: (F.pmod(stable_hash(F.concat_ws(":", F.col("row"), i.cast("string")), seed), F.lit(1_000_000)) / F.lit(100_000.0)).cast("float")
    return spark.range(rows).select(F.col("id").alias("row")).select(
        "row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), unit).alias("features"),
        F.pmod(stable_hash("row", seed + 1), F.lit(2)).cast("int").alias("label"))


def constant_matrix(spark: SparkSession, rows: int, columns: int, value: float = 1.0) -> DataFrame:
    """(row, features)."""
    return spark.range(rows).select(F.col("id").alias("row"), F.array_repeat(F.lit(value).cast("float"), columns).alias("features"))
