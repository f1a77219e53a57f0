"""Two-step flows: records to graph and filter, and a genome to partial suffix arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import graphs, sketches, suffix
from strandline.sources import readers, writers


def parse_k(value: str | None, default: int = 31) -> int:
    """A k given as text; ``default`` where it is missing or no number."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def graph_and_filter(spark: SparkSession, path: str, out: str, k: int = 31, probe: str = "ACGT") -> dict:
    """Writes graph and Bloom bits of a FASTX file; returns counts and whether ``probe`` may be in it."""
    reads = readers.read_fastx(spark, path)
    graph = graphs.simple_graph(reads, k)
    graph.write.mode("overwrite").json(f"{out}/graph")
    nodes = spark.read.schema("kmer string, edges array<string>").json(f"{out}/graph")
    n = nodes.count()
    m = sketches.bloom_size(n)
    items = graphs.windows(reads, k).select("kmer")
    sketches.bloom_bits(items, "kmer", m, 3).write.mode("overwrite").parquet(f"{out}/bloom")
    asked = spark.createDataFrame([(0, probe)], "key long, item string")
    hit = sketches.bloom_probe(asked, "key", "item", spark.read.schema("bit long").parquet(f"{out}/bloom"), m, 3).head()
    return {"nodes": n, "size": m, "num_hashes": 3, "probe": bool(hit and hit["maybe"])}


def partial_arrays(spark: SparkSession, path: str, chunk: int = 1_000_000) -> DataFrame:
    """(start_pos, suffix_positions) of each chunk of a flattened genome."""
    ranked = suffix.chunk_suffix_arrays(readers.flatten_fasta(spark, path, trim=False), "text_id", "text", chunk)
    return ranked.groupBy("text_id", "start_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos"))), lambda x: x["pos"]).alias("suffix_positions")).drop("text_id")


def partial_arrays_json(spark: SparkSession, path: str, chunk: int = 1_000_000) -> DataFrame:
    return writers.json_array(partial_arrays(spark, path, chunk), "start_pos", pretty=True)
