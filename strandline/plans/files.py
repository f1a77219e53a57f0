"""Registered queries over files: tables are written in each format to the shared folder, read back, and queried."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import graphs, sketches, stats
from strandline.plans import flows
from strandline.plans.queries import HASH_SQL, READS_SQL, query, reads, table
from strandline.sources import generators, readers, writers
from strandline.sources.shared import ensure_checkpoint_dir, passing


def written(frame: DataFrame, kind: str) -> str:
    """The path of ``value`` lines, written to a folder that is deleted when the driver ends."""
    path = passing(frame.sparkSession, f"{ensure_checkpoint_dir(frame.sparkSession)}/{kind}-{uuid.uuid4().hex}")
    writers.write_lines(frame, path)
    return path


def folder(spark: SparkSession, kind: str) -> str:
    return passing(spark, f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}")


def fasta(strands: DataFrame) -> str:
    """Two lines of sequence for each record, the source behind the id."""
    value = F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("")), F.lit("\n"), F.substring("s", 1, 60), F.lit("\n"), F.substring("s", 61, 60))
    return written(strands.select(value.alias("value")), "fasta")


def fastq(strands: DataFrame) -> str:
    """Qualities are spelled from the bases; many start with '@'."""
    value = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" r\n"), F.col("s"), F.lit("\n+\n"), F.translate("s", "ACGT", "@I5!"))
    return written(strands.select(value.alias("value")), "fastq")


@query(f"WITH {READS_SQL} SELECT read_id::VARCHAR AS id, coalesce(source, '') AS description, s AS seq FROM reads")
def scan_fasta(spark, sf_dir):
    return readers.read_fasta(spark, fasta(reads(spark, sf_dir))).drop("file")


@query(f"""WITH {READS_SQL} SELECT read_id::VARCHAR AS id, strlen(s)::BIGINT AS seq_len, (length(s) - length(translate(s,'GC','')))::BIGINT AS gc_count,
  round((length(s) - length(translate(s,'GC','')))::DOUBLE / strlen(s)::DOUBLE, 9) AS gc_content FROM reads""")
def scan_fasta_stats(spark, sf_dir):
    """The statistics program from its file on."""
    got = stats.record_stats(readers.read_fasta(spark, fasta(reads(spark, sf_dir))))
    return got.select("id", "seq_len", "gc_count", F.round("gc_content", 9).alias("gc_content"))


@query(f"WITH {READS_SQL} SELECT read_id::VARCHAR AS id, s AS seq, translate(s, 'ACGT', '@I5!') AS qual FROM reads")
def scan_fastq(spark, sf_dir):
    return readers.read_fastq_exact(spark, fastq(reads(spark, sf_dir))).drop("file")


@query(f"""WITH {READS_SQL} SELECT read_id::VARCHAR AS id, s AS seq, 'fasta' AS kind FROM reads
  UNION ALL SELECT read_id::VARCHAR AS id, s AS seq, 'fastq' AS kind FROM reads""")
def scan_fastx(spark, sf_dir):
    """A list of two paths, whose formats are told by their content."""
    strands = reads(spark, sf_dir)
    both = readers.read_fastx(spark, [fasta(strands), fastq(strands)])
    return both.select("id", "seq", F.when(F.col("file").contains("/fasta-"), "fasta").otherwise("fastq").alias("kind"))


@query(f"""WITH {READS_SQL} SELECT read_id::VARCHAR AS qname, (CASE WHEN read_id % 3 = 0 THEN 16 ELSE 0 END)::INT AS flag, 'chr' || (read_id % 7) AS rname, (read_id * 11)::BIGINT AS pos, s AS seq,
    len(list_filter(range(1, length(s) - 2), lambda i: substr(s, i, 4) = 'GATT'))::BIGINT AS hits FROM reads""")
def scan_sam(spark, sf_dir):
    n = F.col("read_id")
    fields = [n, F.when(n % 3 == 0, 16).otherwise(0), F.concat(F.lit("chr"), n % 7), n * 11, F.lit(60), F.concat(F.length("s"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.col("s"), F.lit("*")]
    lines = reads(spark, sf_dir).select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))
    head = spark.createDataFrame([("@HD\tVN:1.6",)], "value string")
    got = readers.read_sam(spark, written(head.unionByName(lines), "sam"))
    return stats.motif_counts(got, "GATT").select("qname", "flag", "rname", "pos", "seq", "hits")


@query("""WITH v AS (SELECT p_partkey, substr(p_name, 1, 4) AS r, [replace(substr(p_name, 5, 3), ',', ''), replace(substr(p_name, 8, 3), ',', '')] AS a FROM part),
  t AS (SELECT p_partkey, r, array_to_string(a, ',') AS alts FROM v)
  SELECT 'chr' || (p_partkey % 22) AS chrom, p_partkey::BIGINT AS pos, r AS ref, alts, len(list_filter(range(1, length(r || alts)), lambda i: substr(r || alts, i, 2) = 'ar'))::BIGINT AS hits FROM t""")
def scan_vcf(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    alt = lambda i: F.regexp_replace(F.substring("p_name", i, 3), ",", "")
    fields = [F.concat(F.lit("chr"), F.col("p_partkey") % 22), F.col("p_partkey"), F.lit("."), F.substring("p_name", 1, 4), F.concat(alt(5), F.lit(","), alt(8)), F.lit("."), F.lit("PASS"), F.lit(".")]
    lines = part.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS",)], "value string")
    got = readers.read_vcf(spark, written(head.unionByName(lines), "vcf"))
    return stats.variant_motif(got, "ar").select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), "hits")


@query(f"WITH {READS_SQL} SELECT sum(length(s))::BIGINT AS n_chars, sum(length(s) - length(translate(s,'GC','')))::BIGINT AS gc FROM reads")
def scan_flattened(spark, sf_dir):
    """Each file as one text without headers; and as a whole."""
    flat = readers.flatten_fasta(spark, fasta(reads(spark, sf_dir)))
    return flat.agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(S.letters("text")).alias("gc"))


@query(f"WITH {READS_SQL} SELECT count(*)::BIGINT AS headers, (sum(length(s)) + sum(length('>' || read_id || ' ' || coalesce(source, ''))) + 3 * count(*))::BIGINT AS n_chars FROM reads")
def scan_whole(spark, sf_dir):
    whole = readers.read_whole(spark, fasta(reads(spark, sf_dir)), "")
    return whole.agg(F.sum(S.occurrences("text", ">")).cast("long").alias("headers"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT 0::BIGINT AS text_id, 'ABABAB' AS text")
def scan_missing(spark, sf_dir):
    return readers.read_whole(spark, f"{folder(spark, 'none')}/none", "ABABAB")


@query(f"WITH {READS_SQL} SELECT count(*)::BIGINT AS n, min(ordinal)::BIGINT AS low, max(ordinal)::BIGINT AS high, count(DISTINCT ordinal)::BIGINT AS different FROM (SELECT row_number() OVER () - 1 AS ordinal FROM reads)")
def record_ordinals(spark, sf_dir):
    numbered = readers.with_ordinal(readers.read_fasta(spark, fasta(reads(spark, sf_dir))))
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_distinct("ordinal").alias("different"))


@query("SELECT 200::BIGINT AS reads, 20::BIGINT AS shortest, 20::BIGINT AS longest, 0::BIGINT AS others, 200::BIGINT AS again")
def random_strands(spark, sf_dir):
    """Generated reads: their number, lengths, letters, and that a second run agrees."""
    a, b = (generators.random_dna(spark, 200, 20, seed=5) for _ in range(2))
    other = F.length(F.translate("seq", "ACGT", "")) > 0
    facts = a.agg(F.count(F.lit(1)).alias("reads"), F.min(F.length("seq")).cast("long").alias("shortest"), F.max(F.length("seq")).cast("long").alias("longest"), F.count_if(other).alias("others"))
    return facts.crossJoin(a.join(b, ["read_id", "seq"]).agg(F.count(F.lit(1)).alias("again")))  # one row each


@query(f"WITH {READS_SQL} SELECT read_id::BIGINT AS id, length(s)::BIGINT AS seq_len FROM reads")
def sink_json_array(spark, sf_dir):
    """One JSON array over many files, read back as one document in the order of their names."""
    path = folder(spark, "array")
    writers.write_json_array(reads(spark, sf_dir).select(F.col("read_id").alias("id"), F.length("s").cast("long").alias("seq_len")), "id", path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"), "value")
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "i", "value"))), lambda x: x["value"]), "").alias("text"))
    return whole.select(F.inline(F.from_json("text", "array<struct<id:long,seq_len:long>>")))


@query(f"""WITH {READS_SQL}, p AS (SELECT substr(s, i, 4) AS kmer, CASE WHEN i + 4 <= length(s) THEN substr(s, i + 1, 4) END AS nxt
    FROM (SELECT s, unnest(range(1, length(s) - 2)) AS i FROM reads))
  SELECT kmer, coalesce(array_to_string(list_sort(list(DISTINCT nxt) FILTER (nxt IS NOT NULL)), ','), '') AS edges FROM p GROUP BY kmer""")
def sink_graph_json(spark, sf_dir):
    """The graph as one JSON object from k-mer to its successors, written and read back; 4-mers, so 256 keys at most."""
    graph = graphs.simple_graph(reads(spark, sf_dir), 4, "s")
    path = written(writers.json_object(graph, "kmer", "edges"), "object")
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("kmer", "edges"))
    return back.select("kmer", F.array_join("edges", ",").alias("edges"))


@query(f"""WITH {READS_SQL}, b AS (SELECT DISTINCT {HASH_SQL.format(x='s', seed='seed')} % 50000 AS bit FROM (SELECT s, unnest(range(0, 5)) AS seed FROM reads))
  SELECT (SELECT count(*) FROM b)::BIGINT AS bits_set, 50000::BIGINT AS size, 5::BIGINT AS num_hashes, (SELECT sum(bit) FROM b)::BIGINT AS bit_sum""")
def sink_bloom_json(spark, sf_dir):
    bits = sketches.bloom_bits(reads(spark, sf_dir), "s")
    path = written(writers.bloom_json(bits, 50_000, 5), "bloom")
    back = spark.read.text(path).select(F.from_json("value", "struct<bits:array<boolean>,num_hashes:long,size:long>").alias("f"))
    on = F.filter(F.transform("f.bits", lambda x, i: F.when(x, i.cast("long"))), lambda x: x.isNotNull())
    return back.select(F.size(on).cast("long").alias("bits_set"), "f.size", "f.num_hashes", F.aggregate(on, F.lit(0).cast("long"), lambda t, x: t + x).alias("bit_sum"))


@query(f"""SELECT r AS row, 200::BIGINT AS cells, (('0x'||substr(md5(r||'#1'),1,15))::BIGINT % 2)::INT AS label,
  round(list_sum(list_transform(range(0, 200), lambda i: ((('0x'||substr(md5(r||':'||i||'#0'),1,15))::BIGINT % 1000000) / 100000.0)::FLOAT::DOUBLE)), 3) AS total FROM range(0, 100) AS t(r)""")
def sink_matrix_csv(spark, sf_dir):
    """Features and label as lines, with the row's number in front so that they can be told apart when read back."""
    m = generators.expression_matrix(spark, 100, 200)
    numbered = writers.matrix_lines(m, "row").select(F.concat_ws(",", F.col("row").cast("string"), "value").alias("value"))
    back = spark.read.text(written(numbered, "csv")).select(F.split("value", ",").alias("c"))
    features = F.slice("c", 2, F.size("c") - 2)
    total = F.aggregate(features, F.lit(0.0).cast("double"), lambda t, x: t + x.cast("float").cast("double"))
    return back.select(F.col("c")[0].cast("long").alias("row"), F.size(features).cast("long").alias("cells"), F.get("c", F.size("c") - 1).cast("int").alias("label"), F.round(total, 3).alias("total"))


@query(f"""WITH {READS_SQL}, k AS (SELECT DISTINCT substr(s, i, 31) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 29)) AS i FROM reads))
  SELECT (SELECT count(*) FROM k)::BIGINT AS nodes, greatest(10 * (SELECT count(*) FROM k), 1000000)::BIGINT AS size, true AS found""")
def flow_graph_and_filter(spark, sf_dir):
    """The two-step flow from a FASTQ file: graph and Bloom bits are written, and a k-mer of the first read is asked for."""
    strands = reads(spark, sf_dir)
    probe = strands.orderBy("read_id").select(F.substring("s", 1, 31).alias("p")).head().p
    said = flows.graph_and_filter(spark, fastq(strands), folder(spark, "flow"), 31, probe)
    return spark.createDataFrame([(said["nodes"], said["size"], said["probe"])], "nodes long, size long, found boolean")


@query(f"""WITH {READS_SQL}, g AS (SELECT string_agg(s, '' ORDER BY read_id) AS t FROM (SELECT read_id, s FROM reads WHERE read_id < (SELECT min(read_id) + 3 FROM reads))),
  c AS (SELECT unnest(range(0, (length(t) + 99) // 100)) AS chunk, t FROM g), x AS (SELECT chunk, substr(t, chunk * 100 + 1, 100) AS p FROM c),
  y AS (SELECT chunk, p, unnest(range(0, length(p))) AS pos FROM x), z AS (SELECT chunk, pos, row_number() OVER (PARTITION BY chunk ORDER BY substr(p, pos + 1)) AS rank FROM y)
  SELECT (chunk * 100)::BIGINT AS start_pos, array_to_string(list(pos ORDER BY rank), ',') AS suffix_positions FROM z GROUP BY chunk""")
def flow_partial_arrays(spark, sf_dir):
    """From a genome of three records to suffix arrays of its chunks."""
    strands = reads(spark, sf_dir)
    first = strands.agg(F.min("read_id").alias("low"))
    three = strands.join(F.broadcast(first)).where(F.col("read_id") < F.col("low") + 3).drop("low")
    path = fasta(three.coalesce(1).sortWithinPartitions("read_id"))
    return flows.partial_arrays(spark, path, 100).select("start_pos", F.array_join("suffix_positions", ",").alias("suffix_positions"))
