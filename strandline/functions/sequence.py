"""Scalar sequence functions. Slices are by character; reported lengths are in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pieces(seq: Column | str, size: int, overlap: int = 0) -> Column:
    """Array of (start, own, piece): parts of ``size`` characters, each with the next ``overlap`` (at most ``size``) behind it.

    The text is cut in one pass. A slice at a place of a long text is reached by walking there from its first byte; inside a
    piece that is a bounded way, so what is done piece by piece takes time in proportion to the text.
    """
    if not 0 <= overlap <= size:
        raise ValueError("overlap must be from 0 to size")
    seq = as_column(seq)
    cut = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    joined = F.zip_with(cut, F.slice(cut, 2, 1 << 30), lambda x, y: F.struct(F.length(x).alias("own"), F.concat(x, F.substring(F.coalesce(y, F.lit("")), 1, overlap)).alias("piece")))
    many = F.transform(joined, lambda z, i: F.struct((i.cast("long") * size).alias("start"), z["own"].alias("own"), z["piece"].alias("piece")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(seq).alias("own"), seq.alias("piece")))
    return F.when(F.length(seq) <= size, one).otherwise(many)


def kmers(seq: Column | str, k: int) -> Column:
    """All windows of ``k`` characters, left to right; an empty array if the text is shorter or null. For texts of bounded
    length: ``graphs.windows`` takes any."""
    if k < 1:
        raise ValueError("k must be at least 1")
    seq = as_column(seq)
    last = F.length(seq) - k
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(seq, i + 1, F.lit(k)))
    return F.when(last >= 0, windows).otherwise(F.array().cast("array<string>"))


def letters(seq: Column | str, alphabet: str = "GC") -> Column:
    """How many characters are in ``alphabet`` (case counts)."""
    seq = as_column(seq)
    return (F.length(seq) - F.length(F.translate(seq, alphabet, ""))).cast("long")


def letter_share(seq: Column | str, alphabet: str = "GC") -> Column:
    """letters / bytes; 0 for an empty text."""
    seq = as_column(seq)
    return letters(seq, alphabet).cast("double") / F.greatest(F.octet_length(seq), F.lit(1)).cast("double")


def _quoted(motif: str) -> str:
    if not motif:
        raise ValueError("the motif must not be empty")
    return "(?=" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in motif) + ")"


def occurrences(seq: Column | str, motif: str) -> Column:
    """Occurrences of ``motif``, overlapping ones included."""
    return F.regexp_count(as_column(seq), F.lit(_quoted(motif))).cast("long")


def prefix_table(pattern: str) -> list[int]:
    """For each end in ``pattern``, the longest proper border."""
    if not pattern:
        raise ValueError("the pattern must not be empty")
    table = [0]
    for c in pattern[1:]:
        n = table[-1]
        while n and c != pattern[n]:
            n = table[n - 1]
        table.append(n + (c == pattern[n]))
    return table


def borders(pattern: Column | str) -> Column:
    """``prefix_table`` of a column of short patterns; empty for an empty one."""
    pattern = as_column(pattern)
    longest = lambda i: F.array_max(F.filter(F.sequence(F.lit(0), i - 1), lambda b: F.substring(pattern, 1, b) == F.substring(pattern, i - b + 1, b)))
    table = F.transform(F.sequence(F.lit(1), F.length(pattern)), longest)
    return F.when(F.length(pattern) > 0, table).otherwise(F.array().cast("array<int>"))


def stable_hash(item: Column | str, seed: Column | int) -> Column:
    """60 bits of md5('item#seed'): never negative, the same in any SQL engine."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat(as_column(item).cast("string"), F.lit("#"), seed.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def digest_dna(item: Column | str, parts: int = 3) -> Column:
    """A reproducible strand of 32 bases for each part, spelled from md5 digits."""
    text = [F.md5(F.concat(as_column(item).cast("string"), F.lit(f"#{p}")).cast("binary")) for p in range(parts)]
    return F.translate(F.concat(*text), "0123456789abcdef", "ACGT" * 4)


def scaled(values: Column | str, backend: str = "cpu") -> Column:
    """Elementwise 32-bit arithmetic by backend: ``cpu`` x 1.1, ``gpu`` x 2, ``fpga`` + 10."""
    rules = {
        "cpu": lambda x: x * F.lit(1.1).cast("float"),
        "gpu": lambda x: x * F.lit(2.0).cast("float"),
        "fpga": lambda x: x + F.lit(10.0).cast("float"),
    }
    if backend not in rules:
        raise ValueError(f"backend must be one of {sorted(rules)}")
    return F.transform(as_column(values), lambda x: rules[backend](x.cast("float")).cast("float"))


def allele_text(ref: Column | str, alts: Column | str) -> Column:
    """REF directly followed by the ALT alleles joined with commas: a motif may lie across that seam."""
    return F.concat(as_column(ref), F.array_join(as_column(alts), ","))
