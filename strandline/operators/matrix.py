"""Neighbour means over feature vectors, generated matrices and index descriptors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.shared import shared_checkpoint


def neighbour_mean(nodes: DataFrame, edges: DataFrame, key: str, features: str, dims: int, eps: float = 1e-8) -> DataFrame:
    """(key, features): sum of the neighbours' vectors / (their number + eps); zeros without neighbours.

    One row for each edge meets ``dims`` sums, so vectors are never exploded into (node, dim) rows; sums combine before
    the shuffle on the source.
    """
    gathered = edges.join(nodes.select(F.col(key).alias("dst"), F.col(features).alias("_f")), "dst")
    sums = gathered.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("_f")[i].cast("double")).alias(f"_s{i}") for i in range(dims)])
    mean = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / (F.coalesce("_n", F.lit(0)) + F.lit(eps)) for i in range(dims)])
    return nodes.select(key).join(sums, F.col(key) == F.col("src"), "left").select(key, mean.alias(features))


def propagate(nodes: DataFrame, edges: DataFrame, key: str, features: str, dims: int, rounds: int) -> DataFrame:
    """``rounds`` neighbour means, lineage cut after each."""
    state = nodes
    for _ in range(rounds):
        state = shared_checkpoint(neighbour_mean(state, edges, key, features, dims))
    return state


class IndexStrategy(Protocol):
    """How an index of one genome type is described, as columns of the genome's size."""

    kind: str

    def node_count(self, size: Column) -> Column: ...

    def coloured(self) -> Column: ...

    def text(self, size: Column) -> Column: ...


@dataclass(frozen=True)
class Linear:
    kind: str = "linear"

    def node_count(self, size: Column) -> Column:
        return F.lit(None).cast("long")

    def coloured(self) -> Column:
        return F.lit(None).cast("boolean")

    def text(self, size: Column) -> Column:
        return F.format_string("LinearIndex for genome of size: %d", size)


@dataclass(frozen=True)
class Graph:
    per_node: int
    has_colours: bool = False
    kind: str = "graph"

    def node_count(self, size: Column) -> Column:
        return F.floor(size / self.per_node).cast("long")

    def coloured(self) -> Column:
        return F.lit(self.has_colours)

    def text(self, size: Column) -> Column:
        return F.format_string("GraphIndex with %d nodes, colored = %s", self.node_count(size), F.lit(str(self.has_colours).lower()))


# fixed values: strategies by genome type, with the bases for each graph node
STRATEGIES: dict[str, IndexStrategy] = {"Microbial": Linear(), "Eukaryotic": Linear(), "Pangenome": Graph(1000, True), "SingleCellTranscriptomic": Graph(2000), "HiCAssay": Graph(500)}


def describe_index(genomes: DataFrame, kind: str = "genome_type", size: str = "approximate_size", strategies: dict[str, IndexStrategy] | None = None) -> DataFrame:
    """Adds index_kind, node_count, is_colored and description by the type's strategy; an unknown type gives nulls.

    ``strategies`` adds types to the registered ones, or replaces theirs.
    """
    known, n = STRATEGIES | (strategies or {}), F.col(size)

    def chosen(value: Callable[[IndexStrategy], Column]) -> Column:
        return F.coalesce(*[F.when(F.col(kind) == name, value(s)) for name, s in known.items()])

    return genomes.withColumns({
        "index_kind": chosen(lambda s: F.lit(s.kind)), "node_count": chosen(lambda s: s.node_count(n)),
        "is_colored": chosen(lambda s: s.coloured()), "description": chosen(lambda s: s.text(n)),
    })
