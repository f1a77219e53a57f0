"""Output forms. Tables go out in parallel; single-document JSON is for results of known small size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_array(frame: DataFrame, order: str, pretty: bool = False) -> DataFrame:
    """One row ``value``: all rows as one JSON array in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*frame.columns).alias("r"))))
    return frame.agg(F.to_json(F.transform(rows, lambda x: x["r"]), {"pretty": str(pretty).lower()}).alias("value"))


def json_object(frame: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``value``: a JSON object from ``key`` to ``value``, in key order."""
    return frame.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))


def json_array_lines(frame: DataFrame, order: str) -> DataFrame:
    """(``order``, value): the lines of one JSON array, to be written in that order by as many tasks as it takes: brackets and
    commas stand in the rows' own lines, so the files in order of their names are the document."""
    named = frame.select(F.col(order).alias("_o"), F.to_json(F.struct(*frame.columns)).alias("_v"))
    ends = frame.agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    rows = named.join(F.broadcast(ends))  # one row
    value = F.concat(F.when(F.col("_o") == F.col("_first"), "[").otherwise(","), F.col("_v"), F.when(F.col("_o") == F.col("_last"), "]").otherwise(""))
    return rows.select(F.col("_o").alias(order), value.alias("value"))


def write_json_array(frame: DataFrame, order: str, path: str) -> None:
    """One JSON array in files whose names are in ``order``, a unique column without nulls; the table is sorted, not gathered."""
    json_array_lines(frame, order).orderBy(order).select("value").write.mode("overwrite").text(path)


def bloom_json(bits: DataFrame, m: int, k: int) -> DataFrame:
    """One row ``value``: {bits, num_hashes, size} with every bit as a boolean. The document has m bits whatever is set; they
    are joined from a string of digits for each word of the bitmap, in time that goes with m."""
    words = bits.sparkSession.range(-(-m // 128)).withColumnRenamed("id", "word")
    on = bits.groupBy((F.col("bit") / 128).cast("long").alias("word")).agg(F.collect_set((F.col("bit") % 128).cast("int")).alias("on"))
    flags = F.transform(F.sequence(F.lit(0), F.least(F.lit(128), F.lit(m) - F.col("word") * 128).cast("int") - 1), lambda i: F.coalesce(F.array_contains("on", i), F.lit(False)).cast("string"))
    parts = words.join(on, "word", "left").select("word", F.array_join(flags, ",").alias("part"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "part"))), lambda x: x["part"]), ",").alias("flags"))
    return whole.select(F.concat(F.lit('{"bits":['), F.col("flags"), F.lit(f'],"num_hashes":{k},"size":{m}}}')).alias("value"))


def matrix_lines(matrix: DataFrame, *keep: str) -> DataFrame:
    """(…keep, value): lines without header: features, then label."""
    cells = F.transform("features", lambda x: x.cast("string"))
    return matrix.select(*keep, F.concat_ws(",", cells, F.col("label").cast("string")).alias("value"))


def write_lines(frame: DataFrame, path: str) -> None:
    frame.select("value").write.mode("overwrite").text(path)


def write_ndjson(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)
