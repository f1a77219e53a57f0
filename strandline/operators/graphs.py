"""k-mer graphs as edge tables. Edges carry multiplicities, so aggregation combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.sources.shared import shared_checkpoint


#: Characters of a piece of a record; windows are taken inside pieces, see ``sequence.pieces``.
PIECE = 256


def windows(records: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = (), at_ends: bool = True) -> DataFrame:
    """A row (…keep, pos, kmer, next) for every window of ``k`` characters; next is null at a record's end, and such rows are
    left out unless ``at_ends``. Time and memory go with the text, however long a record is."""
    if k < 1:
        raise ValueError("k must be at least 1")
    cut = records.where(F.length(seq) >= k).select(*keep, F.inline(S.pieces(seq, max(PIECE, 4 * k), k)))
    n = F.least(F.col("own"), F.length("piece") - (k - 1 if at_ends else k))
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        (F.col("start") + i - 1).alias("pos"), F.substring(F.col("piece"), i, F.lit(k)).alias("kmer"),
        F.when(i + k <= F.length("piece"), F.substring(F.col("piece"), i + 1, F.lit(k))).alias("next"),
    ))
    return cut.where(n >= 1).select(*keep, F.inline(rows))


def steps(records: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row (…keep, pos, src, dst) for every k-mer with a successor in its record."""
    return windows(records, k, seq, keep, at_ends=False).select(*keep, "pos", F.col("kmer").alias("src"), F.col("next").alias("dst"))


def edge_counts(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Directed multigraph as (src, dst, n)."""
    return steps(records, k, seq).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def successor_counts(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(src, successors): arrays of (dst, n), sorted. Edges are counted first, so a hot k-mer's row has the alphabet at most."""
    return edge_counts(records, k, seq).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "n"))).alias("successors"))


def adjacency(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(src, successors): duplicates written out, sorted; for outputs that list them. ``successor_counts`` has bounded rows."""
    listed = F.flatten(F.transform("successors", lambda e: F.array_repeat(e["dst"], e["n"].cast("int"))))
    return successor_counts(records, k, seq).select("src", listed.alias("successors"))


def source_nodes(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(src, out_degree): only k-mers that have a successor."""
    return steps(records, k, seq).groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def all_nodes(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Every distinct k-mer, with or without a successor."""
    return windows(records, k, seq).select("kmer").distinct()


def pangenome(records: DataFrame, k: int, colour: str, seq: str = "seq") -> DataFrame:
    """(src, dst, n, colours): one graph over several haplotypes with the sorted set of colours of each edge."""
    each = steps(records, k, seq, (colour,)).groupBy("src", "dst", colour).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(colour)).alias("colours"))


def simple_graph(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, edges): all k-mers, each with its set of successors, sorted; one shuffle.

    Every k-mer gives one (kmer, successor or null) row, so no join has to add the nodes without successor.
    """
    return windows(records, k, seq).groupBy("kmer").agg(F.array_sort(F.collect_set("next")).alias("edges"))


def partial_nodes(records: DataFrame, k: int, ordinal: str, seq: str = "seq", chunk: int = 100_000) -> DataFrame:
    """(chunk_id, kmer, node): nodes of each run of ``chunk`` records, numbered by first appearance from 0."""
    seen = windows(records, k, seq, (ordinal,)).select(F.expr(f"`{ordinal}` div {chunk}").alias("chunk_id"), F.col(ordinal).alias("ord"), "pos", "kmer")
    first = seen.groupBy("chunk_id", "kmer").agg(F.min(F.struct("ord", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("first")) - 1
    return first.select("chunk_id", "kmer", rank.cast("long").alias("node"))


def partial_edges(records: DataFrame, k: int, ordinal: str, seq: str = "seq", chunk: int = 100_000) -> DataFrame:
    """(chunk_id, a, b, n): undirected indexed multigraph of each chunk, self-loops kept; chunks are never merged."""
    nodes = shared_checkpoint(partial_nodes(records, k, ordinal, seq, chunk))  # for both ends
    pairs = steps(records, k, seq, (ordinal,)).groupBy(F.expr(f"`{ordinal}` div {chunk}").alias("chunk_id"), "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    a = nodes.select("chunk_id", F.col("kmer").alias("src"), F.col("node").alias("a"))
    b = nodes.select("chunk_id", F.col("kmer").alias("dst"), F.col("node").alias("b"))
    return pairs.join(a, ["chunk_id", "src"]).join(b, ["chunk_id", "dst"]).select("chunk_id", "a", "b", "n")


def partial_graphs(records: DataFrame, k: int, ordinal: str, seq: str = "seq", chunk: int = 100_000) -> DataFrame:
    """(chunk_id, nodes, edges, k): one row for each chunk, the form that is written as JSON."""
    nodes = partial_nodes(records, k, ordinal, seq, chunk).groupBy("chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node", "kmer"))), lambda x: x["kmer"]).alias("nodes"))
    edges = partial_edges(records, k, ordinal, seq, chunk).groupBy("chunk_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "n"))), lambda e: F.array_repeat(F.array(e["a"], e["b"]), e["n"].cast("int")))).alias("edges"))
    return nodes.join(edges, "chunk_id", "left").select(
        "chunk_id", "nodes", F.coalesce("edges", F.array().cast("array<array<long>>")).alias("edges"), F.lit(k).cast("long").alias("k"))


def chain_field(records: DataFrame, ordinal: str, seq: str = "seq", potential: float = 1.0) -> DataFrame:
    """(seq_id, pos, nbr_pos, potential): each position linked to the next one of its record."""
    last = F.length(seq) - 2
    return records.where(F.length(seq) >= 2).select(
        F.col(ordinal).alias("seq_id"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("pos"),
    ).select("seq_id", "pos", (F.col("pos") + 1).alias("nbr_pos"), F.lit(potential).cast("float").alias("potential"))
