"""Pattern positions in whole and chunked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import pieces


def _hits(text: Column, pattern: str) -> Column:
    """0-based starts, overlapping ones included: the text is cut at matches of a lookahead, so it is scanned once."""
    if not pattern:
        raise ValueError("the pattern must not be empty")
    quoted = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in pattern)
    pieces = F.split(text, f"(?={quoted})")
    lengths = F.transform(pieces, lambda p: F.length(p).cast("long"))
    ends = F.aggregate(F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), F.array().cast("array<long>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + n)))
    starts = F.when(F.startswith(text, F.lit(pattern)), F.concat(F.array(F.lit(0).cast("long")), F.filter(ends, lambda e: e > 0))).otherwise(ends)
    return F.when(F.length(text) >= len(pattern), starts).otherwise(F.array().cast("array<long>"))


#: Characters searched at once.
PIECE = 1_024


def positions(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, pos) of all matches, in time that goes with the text."""
    return chunk_positions(texts, key, text, pattern, max(PIECE, len(pattern)))


def position_lists(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, positions): the places of all matches in a text, in order; texts without a match are left out."""
    return positions(texts, key, text, pattern).groupBy(key).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def chunk_bounds(length: Column, n: int) -> Column:
    """(start, end) of ``n`` chunks of equal, rounded-up size; those past the end are empty."""
    size = F.ceil(length / F.lit(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.least(i * size, length).cast("long").alias("start"), F.least((i + 1) * size, length).cast("long").alias("end")))


def even_bounds(length: Column, n: int) -> Column:
    """(start, end) of ``n`` chunks of rounded-down size; the last takes the rest."""
    if n < 1:
        raise ValueError("n must be at least 1")
    size = F.floor(length / F.lit(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * size).cast("long").alias("start"), F.when(i == n - 1, length).otherwise((i + 1) * size).cast("long").alias("end")))


def chunk_positions(texts: DataFrame, key: str, text: str, pattern: str, chunk: int = 4_096, overlap: bool = True) -> DataFrame:
    """(key, pos) from chunks of ``chunk`` characters, each with the next len(pattern) - 1 characters unless ``overlap`` is off."""
    if not pattern:
        raise ValueError("the pattern must not be empty")
    if overlap and chunk < len(pattern) - 1:  # the overlap comes from one neighbour; no match is lost in larger chunks either
        chunk = len(pattern)
    cut = texts.where(F.length(text) > 0).select(key, F.inline(pieces(text, chunk, (len(pattern) - 1) * overlap)))
    return cut.select(key, "start", F.explode(_hits(F.col("piece"), pattern)).alias("_at")).select(key, (F.col("start") + F.col("_at")).alias("pos"))


def rank_positions(texts: DataFrame, key: str, text: str, pattern: str, n: int, overlap: bool = True, even: bool = False) -> DataFrame:
    """(key, pos) from ``n`` chunks of each text, by ``chunk_bounds`` or ``even_bounds``; without overlap, matches across a
    boundary are lost. A chunk takes its own part of the text with it, and is searched piece by piece."""
    more = (len(pattern) - 1) * overlap
    bounds = (even_bounds if even else chunk_bounds)(F.length(text), n)
    parts = F.transform(bounds, lambda b: F.struct(b["start"].alias("_from"), F.substring(F.col(text), (b["start"] + 1).cast("int"), F.greatest(b["end"] - b["start"], F.lit(0)).cast("int") + F.when(b["end"] > b["start"], more).otherwise(0)).alias("_part")))
    cut = texts.where(F.length(text) > 0).select(key, F.inline(parts)).select(F.struct(key, "_from").alias("_key"), "_part")
    return positions(cut, "_key", "_part", pattern).select(F.col(f"_key.{key}").alias(key), (F.col("_key._from") + F.col("pos")).alias("pos"))
