"""Edge counts kept up to date as record files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.graphs import steps


def edge_stream(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(src, dst, n) over all records seen so far; for update or complete output."""
    return steps(records, k, seq).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def append_edges(records: DataFrame, k: int, path: str, checkpoint: str, seq: str = "seq"):
    """Writes each batch's counts as one folder named by its number: a replayed batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        edge_stream(batch, k, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, n) summed over the batches written so far."""
    return spark.read.parquet(path).groupBy("src", "dst").agg(F.sum("n").alias("n"))
