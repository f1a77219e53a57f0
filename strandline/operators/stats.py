"""Per-record statistics and motif totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as S


def record_stats(records: DataFrame, seq: str = "seq", alphabet: str = "GC") -> DataFrame:
    """Adds seq_len (bytes), gc_count and gc_content. Narrow: no shuffle."""
    return records.withColumns({
        "seq_len": F.octet_length(seq).cast("long"),
        "gc_count": S.letters(seq, alphabet),
        "gc_content": S.letter_share(seq, alphabet),
    })


def letter_total(records: DataFrame, seq: str = "seq", alphabet: str = "GC", min_bytes: int = 50) -> DataFrame:
    """One row: the letters of all records of at least ``min_bytes``; 0 if there are none."""
    kept = records.where(F.octet_length(seq) >= min_bytes)
    return kept.agg(F.coalesce(F.sum(S.letters(seq, alphabet)), F.lit(0)).cast("long").alias("gc_total"))


def motif_counts(records: DataFrame, motif: str, seq: str = "seq") -> DataFrame:
    return records.withColumn("hits", S.occurrences(seq, motif))


def motif_total(records: DataFrame, motif: str, seq: str = "seq") -> DataFrame:
    """One row: records and overlapping occurrences over all of them."""
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(S.occurrences(seq, motif)), F.lit(0)).cast("long").alias("hits"),
    )


def variant_motif(variants: DataFrame, motif: str, per_allele: bool = False) -> DataFrame:
    """Adds hits: over REF + joined ALT, or the sum over single alleles."""
    if per_allele:
        single = F.transform(F.concat(F.array("ref"), F.col("alts")), lambda a: S.occurrences(a, motif))
        return variants.withColumn("hits", F.aggregate(single, F.lit(0).cast("long"), lambda t, x: t + x))
    return variants.withColumn("hits", S.occurrences(S.allele_text("ref", "alts"), motif))
