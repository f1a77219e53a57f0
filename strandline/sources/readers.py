"""Sequence and alignment files as DataFrames.

Line formats go through Spark's own text reader, so they are split, read from any Hadoop store and decompressed by
suffix (.gz, .bz2, .zst). Binary containers are read a file at a time (Spark's limit is 2 GB a file).

``mode``: FAILFAST raises at the first malformed record, DROPMALFORMED leaves it out.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import urllib.request
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.shared import importable, shared_checkpoint

Paths = str | list[str]


def _policy(frame: DataFrame, ok: Column, mode: str, what: str) -> DataFrame:
    if mode == "DROPMALFORMED":
        return frame.where(ok)
    if mode != "FAILFAST":
        raise ValueError("mode must be FAILFAST or DROPMALFORMED")
    # in the projection, so that the check cannot be pruned from a filter
    first = frame.columns[0]
    return frame.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit(f"malformed {what} record")).cast("string")))


def _decoded(value: Column, errors: str) -> Column:
    if errors == "strict":
        return F.validate_utf8(value)
    if errors == "replace":
        return F.make_valid_utf8(value)
    raise ValueError("encoding_errors must be strict or replace")


def _first_lines(spark: SparkSession, paths: Paths) -> dict[str, str]:
    """The first line with anything in it of each file, of its first 64 kB after decompression; files are opened side by side."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)

    def first(name: str) -> tuple[str, str]:
        where = hadoop.fs.Path(spark._jvm.java.net.URI(name))
        stream, codec = where.getFileSystem(conf).open(where), codecs.getCodec(where)
        try:
            raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(codec.createInputStream(stream) if codec else stream, 1 << 16)))
        finally:
            stream.close()
        return name, next((x for x in raw.decode("utf-8", "replace").splitlines() if x.strip()), "")

    with ThreadPoolExecutor(16) as pool:
        return dict(pool.map(first, spark.read.text(paths).inputFiles()))


def read_fasta(spark: SparkSession, paths: Paths, mode: str = "FAILFAST", encoding_errors: str = "strict") -> DataFrame:
    """(id, description, seq, file). Records begin at a '>' that follows a line end, so headers may hold '>'.

    What stands in a file before its first '>' is no record: FAILFAST raises, DROPMALFORMED leaves it out.
    """
    stray = {name: line for name, line in _first_lines(spark, paths).items() if line and not line.startswith(">")}
    if stray and mode == "FAILFAST":
        raise ValueError(f"not a FASTA file: {min(stray)}")
    raw = spark.read.option("lineSep", "\n>").text(paths).select(_decoded(F.col("value"), encoding_errors).alias("value"), F.col("_metadata.file_path").alias("file"))
    for name, line in stray.items():
        raw = raw.where(~((F.regexp_replace("file", "^file:/+", "file:/") == re.sub("^file:/+", "file:/", name)) & F.startswith(F.ltrim("value"), F.lit(line))))
    body = F.regexp_replace("value", "^>", "")
    cut = F.split(body, "\n", 2)
    header = F.rtrim(F.regexp_replace(cut[0], "\r$", ""))
    out = raw.where(F.length(F.trim(F.regexp_replace("value", r"[\r\n>]", ""))) > 0).select(
        F.regexp_extract(header, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"),
        F.regexp_replace(F.coalesce(F.get(cut, 1), F.lit("")), r"\s+", "").alias("seq"), "file")
    return _policy(out, F.length("id") > 0, mode, "FASTA")


def read_fastq(spark: SparkSession, paths: Paths, mode: str = "FAILFAST", encoding_errors: str = "strict") -> DataFrame:
    """(id, seq, qual, file) of four-line records in one pass, split at a line that starts with '@'.

    A quality line may start with '@' as well and lie behind a split of the file. So that rows do not depend on splits, every
    such quality is null; its length is checked where it is at hand. ``read_fastq_exact`` keeps it.
    """
    parts = _fastq_rows(spark, paths, encoding_errors).where("state <> 1")
    ok = F.col("fits") & F.startswith("plus", F.lit("+")) & ((F.col("state") == 2) | (F.length("qual") == F.length("seq")))
    told = _policy(_named(parts, "state"), F.coalesce(ok, F.lit(False)), mode, "FASTQ")
    return told.select("id", "seq", F.when(~F.startswith("qual", F.lit("@")), F.col("qual")).alias("qual"), "file")


FASTQ_PARTS = "id string, seq string, plus string, qual string, fits boolean, state int, file string, start long, stop long"


def _fastq_parts(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, file, start, length, size) cut at lines that start with '@', in order, to records (state 0).

    A row of three lines waits for its quality, which starts with '@' and is the row behind. At a block's end it goes out as
    state 2, or as a malformed record if the file ends there, and a quality at a block's begin as state 1.
    """
    names = [x.split(" ")[0] for x in FASTQ_PARTS.split(", ")]
    kinds = [pa.string()] * 4 + [pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    block, waiting = None, None

    def left() -> tuple:
        file, start, length, size = block
        last = start + length >= size
        return (*waiting, None, not last, 0 if last else 2, file, start, start + length)

    for batch in stream:
        out = []
        for value, *where in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start", "length", "size")), strict=True):
            begins = where != block
            if begins and waiting:
                out.append(left())
            block, waiting = where, None if begins else waiting
            lines = value.replace("\r", "").rstrip("\n").split("\n")
            at = (where[0], where[1], where[1] + where[2])
            if begins and where[1] == 0:
                if not any(lines):
                    continue
                named = lines[0].startswith("@")
                lines[0] = lines[0].removeprefix("@")
            else:
                named = True
            if len(lines) == 3 and not lines[1]:  # no letters: the empty quality went with the line ends
                lines.append("")
            if waiting and len(lines) > 1:  # no quality follows: that record is malformed, this one may be sound
                out.append((*waiting, None, False, 0, *at))
                waiting = None
            if waiting:
                out.append((*waiting, "@" + lines[0], True, 0, *at))
                waiting = None
            elif len(lines) == 1 and begins and where[1]:
                out.append((None, None, None, "@" + lines[0], True, 1, *at))
            elif len(lines) == 3 and named:
                waiting = tuple(lines)
            else:
                out.append((*(lines + [None] * 4)[:4], named and len(lines) == 4, 0, *at))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(left(), kinds, strict=True)], names)


def _fastq_rows(spark: SparkSession, paths: Paths, encoding_errors: str = "strict") -> DataFrame:
    where = F.col("_metadata")
    raw = importable(spark).read.option("lineSep", "\n@").text(paths).select(
        _decoded(F.col("value"), encoding_errors).alias("value"), where["file_path"].alias("file"), where["file_block_start"].alias("start"), where["file_block_length"].alias("length"), where["file_size"].alias("size"))
    return raw.mapInArrow(_fastq_parts, FASTQ_PARTS)


def _named(records: DataFrame, *keep: str) -> DataFrame:
    return records.select(F.regexp_extract(F.coalesce("id", F.lit("")), r"^(\S*)", 1).alias("id"), "seq", "plus", "qual", "fits", *keep, "file")


def _per_file(spark: SparkSession, paths: Paths, parse, schema: str) -> DataFrame:
    """Rows of ``parse(bytes)`` for each file, gunzipped if it is a gzip or BGZF stream."""
    import pandas as pd

    names = [x.strip().split(" ", 1)[0] for x in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, path in zip(batch["content"], batch["path"], strict=True):
                plain = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(*r, path) for r in parse(plain)]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=names)

    paths = [paths] if isinstance(paths, str) else paths
    return importable(spark).read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def read_fastq_exact(spark: SparkSession, paths: Paths, mode: str = "FAILFAST") -> DataFrame:
    """(id, seq, qual, file) with every quality line, whatever it starts with; files are split as by ``read_fastq``.

    A first pass finds the records that lie on both sides of a split, one at most for each. A record that the file's end cuts
    off is malformed.
    """
    parts = _fastq_rows(spark, paths)
    loose = shared_checkpoint(parts.where("state > 0"))
    heads = loose.where("state = 1").select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("qual").alias("_qual"))
    both = loose.where("state = 2").join(heads, (F.col("file") == F.col("_file")) & (F.col("stop") == F.col("_start")), "full")
    joined = both.select("id", "seq", "plus", F.col("_qual").alias("qual"), (F.col("_qual").isNotNull() & F.col("id").isNotNull()).alias("fits"), F.coalesce("file", "_file").alias("file"))
    every = parts.where("state = 0").select("id", "seq", "plus", "qual", "fits", "file").unionByName(joined)
    ok = F.col("fits") & F.startswith("plus", F.lit("+")) & (F.length("qual") == F.length("seq"))
    return _policy(_named(every), F.coalesce(ok, F.lit(False)), mode, "FASTQ").drop("plus", "fits")


def read_fastx(spark: SparkSession, paths: Paths, mode: str = "FAILFAST", encoding_errors: str = "strict") -> DataFrame:
    """(id, seq, qual, file): FASTA or FASTQ, told by the first character of the first record read."""
    paths = [paths] if isinstance(paths, str) else paths
    parts = []
    for path in paths:
        head = spark.read.text(path).where(F.length("value") > 0).head()
        first = head[0][0] if head else ">"
        if first not in "@>":
            raise ValueError(f"neither FASTA nor FASTQ: {path}")
        parts.append(read_fastq(spark, path, mode, encoding_errors) if first == "@" else read_fasta(spark, path, mode, encoding_errors).select("id", "seq", F.lit(None).cast("string").alias("qual"), "file"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_sam(spark: SparkSession, paths: Paths, mode: str = "FAILFAST", lenient: bool = False) -> DataFrame:
    """The eleven fixed fields of each alignment; ``lenient`` splits at runs of white space instead of tabs."""
    raw = spark.read.text(paths).where(~F.startswith("value", F.lit("@")) & (F.length(F.trim("value")) > 0))
    f = F.split("value", r"\s+" if lenient else "\t")
    # fixed values: names and types of the fields, in file order
    fields = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string")]
    out = raw.select(*[F.get(f, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)], F.size(f).alias("_n"))
    return _policy(out, (F.col("_n") >= 11) & F.col("flag").isNotNull(), mode, "SAM").drop("_n")


def read_vcf(spark: SparkSession, paths: Paths, mode: str = "FAILFAST") -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filter, info)."""
    raw = spark.read.text(paths).where(~F.startswith("value", F.lit("#")) & (F.length(F.trim("value")) > 0))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    alts = F.when(F.get(f, 4) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get(f, 4), ","))
    out = raw.select(F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("pos"), F.get(f, 2).alias("id"), F.get(f, 3).alias("ref"), alts.alias("alts"), F.get(f, 5).try_cast("double").alias("qual"), F.get(f, 6).alias("filter"), F.get(f, 7).alias("info"), F.size(f).alias("_n"))
    return _policy(out, (F.col("_n") >= 5) & F.col("pos").isNotNull(), mode, "VCF").drop("_n")


def bam_records(data: bytes) -> Iterator[tuple]:
    """Alignments of a decompressed BAM stream; all of them, whatever their flags."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM stream")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n,), at = struct.unpack_from("<i", data, at), at + 4
    names = []
    for _ in range(n):
        (size,) = struct.unpack_from("<i", data, at)
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", data, at + 4)
        p = at + 36
        name = data[p : p + n_name - 1].decode()
        p += n_name
        cigar = "".join(f"{v >> 4}{'MIDNSHP=X'[v & 15]}" for v in struct.unpack_from(f"<{n_cigar}I", data, p)) or "*"
        p += 4 * n_cigar
        packed = data[p : p + (n_seq + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:n_seq]
        quals = data[p + len(packed) : p + len(packed) + n_seq]
        qual = "*" if not quals or quals[0] == 255 else bytes(q + 33 for q in quals).decode()
        yield name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, seq, qual
        at += 4 + size


def read_bam(spark: SparkSession, paths: Paths) -> DataFrame:
    return _per_file(spark, paths, bam_records, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, file string")


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(count, type, next) of a BCF typing byte."""
    n, kind = data[at] >> 4, data[at] & 15
    at += 1
    if n == 15:
        _, inner, at = _typed(data, at)
        form = {1: "<b", 2: "<h", 3: "<i"}[inner]
        n = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
    return n, kind, at


def _text(data: bytes, at: int) -> tuple[str, int]:
    n, _, at = _typed(data, at)
    return data[at : at + n].decode(), at + n


def bcf_records(data: bytes) -> Iterator[tuple]:
    """(chrom, pos, id, ref, alts) of a decompressed BCF2 stream."""
    if data[:3] != b"BCF":
        raise ValueError("not a BCF stream")
    (size,) = struct.unpack_from("<I", data, 5)
    head = data[9 : 9 + size].rstrip(b"\0").decode()
    chroms = [line.split("ID=", 1)[1].split(",")[0].rstrip(">") for line in io.StringIO(head) if line.startswith("##contig=<")]
    chroms = [c.strip().rstrip(">") for c in chroms]
    at = 9 + size
    while at + 8 <= len(data):
        shared, indiv = struct.unpack_from("<II", data, at)
        chrom, pos, _, _, packed = struct.unpack_from("<iiifI", data, at + 8)
        p, n_allele = at + 8 + 24, packed >> 16
        name, p = _text(data, p)
        alleles = []
        for _ in range(n_allele):
            allele, p = _text(data, p)
            alleles.append(allele)
        yield chroms[chrom], pos + 1, name or ".", alleles[0] if alleles else "", alleles[1:]
        at += 8 + shared + indiv


def read_bcf(spark: SparkSession, paths: Paths) -> DataFrame:
    return _per_file(spark, paths, bcf_records, "chrom string, pos long, id string, ref string, alts array<string>, file string")


def with_ordinal(frame: DataFrame, name: str = "ordinal") -> DataFrame:
    """Dense ordinals in partition order from two scans and no shuffle; only counts for each partition are joined."""
    from pyspark.sql import Window

    marked = frame.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    placed = marked.join(F.broadcast(starts), part == F.col("_part"))  # a row for each input partition
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


def flatten_fasta(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """(text_id, text): all sequence lines of each file in one text. A header is told before trimming."""
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: ~F.startswith(x, F.lit(">")))
    kept = F.transform(lines, F.trim) if trim else lines
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("text_id"), F.array_join(kept, "").alias("text"))


def read_whole(spark: SparkSession, path: str, fallback: str) -> DataFrame:
    """(text_id, text) of a file with its line ends, or ``fallback`` if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("text_id"), F.col("value").alias("text"))
    except AnalysisException:
        return spark.createDataFrame([(0, fallback)], "text_id long, text string")


def download(url: str, path: str, timeout: float = 60.0) -> int:
    """Copies a URL to a file in blocks; an HTTP error is raised. Returns the bytes written."""
    total = 0
    with urllib.request.urlopen(url, timeout=timeout) as source, open(path, "wb") as sink:  # noqa: S310
        while block := source.read(1 << 20):
            total += sink.write(block)
    return total
