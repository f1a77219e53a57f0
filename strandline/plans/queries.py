"""Registered queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import graphs, matrix, search, sketches, stats, suffix
from strandline.sources import generators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB's form of the strands that digest_dna spells.
READS_SQL = """reads AS (SELECT doc_id AS read_id, source, lang,
  translate(concat(md5(concat(doc_id,'#0')), md5(concat(doc_id,'#1')), md5(concat(doc_id,'#2'))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM documents)"""
HASH_SQL = "('0x'||substr(md5({x}||'#'||{seed}),1,15))::BIGINT"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 96-base strand for each document; only the columns a query uses are read."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "source", "lang", S.digest_dna("doc_id").alias("s"))


def _edges_sql(k: int, extra: str = "") -> str:
    return f"""{READS_SQL}, e AS (SELECT read_id{extra}, i - 1 AS pos, substr(s, i, {k}) AS src, substr(s, i + 1, {k}) AS dst
  FROM (SELECT *, unnest(range(1, length(s) - {k} + 1)) AS i FROM reads WHERE length(s) > {k}))"""


@query("""SELECT doc_id, strlen(text)::BIGINT AS seq_len, (length(text) - length(translate(text,'GC','')))::BIGINT AS gc_count,
  round((length(text) - length(translate(text,'GC','')))::DOUBLE / greatest(strlen(text),1)::DOUBLE, 9) AS gc_content FROM documents""")
def seq_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stats.record_stats(docs, "text").select("doc_id", "seq_len", "gc_count", F.round("gc_content", 9).alias("gc_content"))


@query(f"WITH {READS_SQL} SELECT coalesce(sum(length(s) - length(translate(s,'GC',''))),0)::BIGINT AS gc_total FROM reads WHERE strlen(s) >= 50")
def gc_total_min_len(spark, sf_dir):
    return stats.letter_total(reads(spark, sf_dir), "s", min_bytes=50)


@query("""SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: l[i]='a' AND l[i+1]='n'))::BIGINT AS hits
  FROM (SELECT doc_id, string_split(text,'') AS l FROM documents)""")
def motif_overlap(spark, sf_dir):
    return stats.motif_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "an", "text").select("doc_id", "hits")


@query(f"""WITH {READS_SQL} SELECT count(*)::BIGINT AS n_records,
  coalesce(sum(len(list_filter(range(1, length(s) - 2), lambda i: substr(s, i, 4) = 'GATT'))),0)::BIGINT AS hits FROM reads""")
def motif_total(spark, sf_dir):
    return stats.motif_total(reads(spark, sf_dir), "GATT", "s")


@query(f"""WITH {READS_SQL} SELECT read_id AS seq_id, (i)::BIGINT AS pos, (i + 1)::BIGINT AS nbr_pos, 1.0::FLOAT AS potential
  FROM (SELECT read_id, unnest(range(0, length(s) - 1)) AS i FROM reads)""")
def mrf_edges(spark, sf_dir):
    return graphs.chain_field(reads(spark, sf_dir), "read_id", "s")


@query(f"WITH {READS_SQL} SELECT sum(greatest(length(s) - 1, 0))::BIGINT AS n_nodes FROM reads")
def mrf_nodes(spark, sf_dir):
    return reads(spark, sf_dir).agg(F.sum(F.greatest(F.length("s") - 1, F.lit(0))).cast("long").alias("n_nodes"))


@query(f"WITH {_edges_sql(6)} SELECT src, dst, count(*)::BIGINT AS n FROM e GROUP BY src, dst")
def debruijn_edges(spark, sf_dir):
    return graphs.edge_counts(reads(spark, sf_dir), 6, "s")


@query(f"WITH {_edges_sql(21)} SELECT src, count(*)::BIGINT AS out_degree FROM e GROUP BY src")
def debruijn_nodes(spark, sf_dir):
    return graphs.source_nodes(reads(spark, sf_dir), 21, "s")


@query(f"WITH {_edges_sql(6)} SELECT src, array_to_string(list_sort(list(dst)), ',') AS successors FROM e GROUP BY src")
def debruijn_adjacency(spark, sf_dir):
    return graphs.adjacency(reads(spark, sf_dir), 6, "s").select("src", F.array_join("successors", ",").alias("successors"))


@query(f"WITH {READS_SQL} SELECT DISTINCT substr(s, i, 8) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 6)) AS i FROM reads)")
def kmer_nodes(spark, sf_dir):
    return graphs.all_nodes(reads(spark, sf_dir), 8, "s")


@query(f"""WITH {_edges_sql(5, ', lang')} SELECT src, dst, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS colours
  FROM e GROUP BY src, dst""")
def pangenome(spark, sf_dir):
    return graphs.pangenome(reads(spark, sf_dir), 5, "lang", "s").withColumn("colours", F.array_join("colours", ","))


@query(f"""WITH {READS_SQL}, p AS (SELECT substr(s, i, 5) AS kmer, CASE WHEN i + 5 <= length(s) THEN substr(s, i + 1, 5) END AS nxt
    FROM (SELECT s, unnest(range(1, length(s) - 3)) AS i FROM reads))
  SELECT kmer, coalesce(array_to_string(list_sort(list(DISTINCT nxt) FILTER (nxt IS NOT NULL)), ','), '') AS edges FROM p GROUP BY kmer""")
def debruijn_simple(spark, sf_dir):
    return graphs.simple_graph(reads(spark, sf_dir), 5, "s").withColumn("edges", F.array_join("edges", ","))


PARTIAL_SQL = f"""{READS_SQL}, k AS (SELECT read_id // 100000 AS chunk_id, read_id, i, substr(s, i, 31) AS kmer
    FROM (SELECT read_id, s, unnest(range(1, length(s) - 29)) AS i FROM reads)),
  f AS (SELECT chunk_id, kmer, min(read_id * 1000 + i) AS o FROM k GROUP BY chunk_id, kmer),
  node AS MATERIALIZED (SELECT chunk_id, kmer, (row_number() OVER (PARTITION BY chunk_id ORDER BY o) - 1)::BIGINT AS node FROM f)"""


@query(f"WITH {PARTIAL_SQL} SELECT chunk_id::BIGINT AS chunk_id, kmer, node FROM node")
def partial_nodes(spark, sf_dir):
    return graphs.partial_nodes(reads(spark, sf_dir), 31, "read_id", "s")


@query(f"""WITH {PARTIAL_SQL}, s AS MATERIALIZED (SELECT chunk_id, read_id, i, kmer, lead(kmer) OVER (PARTITION BY read_id ORDER BY i) AS nxt FROM k),
  e AS MATERIALIZED (SELECT chunk_id, kmer AS src, nxt AS dst, count(*)::BIGINT AS n FROM s WHERE nxt IS NOT NULL GROUP BY chunk_id, kmer, nxt),
  name AS MATERIALIZED (SELECT chunk_id || ' ' || kmer AS label, node FROM node)
  SELECT e.chunk_id::BIGINT AS chunk_id, (SELECT any_value(node) FROM name WHERE label = e.chunk_id || ' ' || e.src) AS a,
    (SELECT any_value(node) FROM name WHERE label = e.chunk_id || ' ' || e.dst) AS b, n FROM e""")
def partial_debruijn(spark, sf_dir):
    return graphs.partial_edges(reads(spark, sf_dir), 31, "read_id", "s")


SUFFIX_SQL = f"""WITH {READS_SQL}, x AS (SELECT read_id, s, unnest(range(0, length(s))) AS pos FROM reads),
  r AS (SELECT read_id, (row_number() OVER (PARTITION BY read_id ORDER BY substr(s, pos + 1)) - 1)::BIGINT AS rank, pos::BIGINT AS pos FROM x)"""


@query(f"{SUFFIX_SQL} SELECT * FROM r")
def suffix_array(spark, sf_dir):
    return suffix.suffix_arrays(reads(spark, sf_dir), "read_id", "s")


@query(f"{SUFFIX_SQL} SELECT * FROM r WHERE rank < 10")
def topk_suffix(spark, sf_dir):
    return suffix.first_suffixes(reads(spark, sf_dir), "read_id", "s", 10)


@query(f"""WITH {READS_SQL}, c AS (SELECT read_id, unnest(range(0, 3)) AS chunk_id, s FROM reads),
  x AS (SELECT read_id, chunk_id, substr(s, chunk_id * 32 + 1, 32) AS t FROM c),
  y AS (SELECT read_id, chunk_id, t, unnest(range(0, length(t))) AS pos FROM x)
  SELECT read_id, chunk_id::BIGINT AS chunk_id, (chunk_id * 32)::BIGINT AS start_pos,
    (row_number() OVER (PARTITION BY read_id, chunk_id ORDER BY substr(t, pos + 1)) - 1)::BIGINT AS rank, pos::BIGINT AS pos FROM y""")
def partial_suffix_array(spark, sf_dir):
    return suffix.chunk_suffix_arrays(reads(spark, sf_dir), "read_id", "s", 32)


SLOTS_SQL = f"SELECT {HASH_SQL.format(x='s', seed='seed')} % 50000 AS bit FROM (SELECT s, unnest(range(0, 5)) AS seed FROM reads)"


@query(f"WITH {READS_SQL} SELECT DISTINCT bit::BIGINT AS bit FROM ({SLOTS_SQL})")
def bloom_bits(spark, sf_dir):
    return sketches.bloom_bits(reads(spark, sf_dir), "s")


@query(f"""WITH {READS_SQL}, b AS (SELECT DISTINCT bit FROM ({SLOTS_SQL})),
  p AS (SELECT read_id, true AS member, s FROM reads UNION ALL SELECT read_id, false AS member, reverse(s) AS s FROM reads),
  q AS (SELECT read_id, member, {HASH_SQL.format(x='s', seed='seed')} % 50000 AS bit FROM (SELECT read_id, member, s, unnest(range(0, 5)) AS seed FROM p))
  SELECT q.read_id, q.member, bool_and(b.bit IS NOT NULL) AS maybe FROM q LEFT JOIN b ON q.bit = b.bit GROUP BY q.read_id, q.member""")
def bloom_probe(spark, sf_dir):
    """Every read is inserted; reads and, as strangers, reads spelled backwards are looked up."""
    strands = reads(spark, sf_dir)
    bits = sketches.bloom_bits(strands, "s")
    members = sketches.bloom_probe(strands, "read_id", "s", bits).withColumn("member", F.lit(True))
    others = sketches.bloom_probe(strands.withColumn("s", F.reverse("s")), "read_id", "s", bits).withColumn("member", F.lit(False))
    return members.unionByName(others).select("read_id", "member", "maybe")


MINHASH_SQL = f"""{READS_SQL}, k AS (SELECT DISTINCT lang, substr(s, i, 6) AS kmer FROM (SELECT lang, s, unnest(range(1, length(s) - 4)) AS i FROM reads)),
  m AS (SELECT lang, seed::BIGINT AS seed, min({HASH_SQL.format(x='kmer', seed='seed')}) AS min_hash
    FROM (SELECT lang, kmer, unnest(range(0, 100)) AS seed FROM k) GROUP BY lang, seed)"""


def _minhash(spark, sf_dir):
    kmers = reads(spark, sf_dir).select("lang", F.col("s"))
    kmers = graphs.windows(kmers, 6, "s", ("lang",)).select("lang", "kmer").distinct()
    return sketches.minhash(kmers, "lang", "kmer")


@query(f"WITH {MINHASH_SQL} SELECT lang, seed, min_hash FROM m")
def minhash_sig(spark, sf_dir):
    return _minhash(spark, sf_dir)


@query(f"""WITH {MINHASH_SQL} SELECT x.lang AS a, y.lang AS b, avg((x.min_hash = y.min_hash)::INT::DOUBLE) AS jaccard
  FROM m x JOIN m y ON x.seed = y.seed AND x.lang < y.lang GROUP BY 1, 2""")
def minhash_jaccard(spark, sf_dir):
    return sketches.jaccard(_minhash(spark, sf_dir), "lang")


KMP_SQL = """SELECT doc_id, unnest(list_filter(range(1, len(l) - 2), lambda i: l[i]='t' AND l[i+1]='i' AND l[i+2]='o' AND l[i+3]='n'))::BIGINT - 1 AS pos
  FROM (SELECT doc_id, string_split(text,'') AS l FROM documents)"""


@query(KMP_SQL)
def kmp_positions(spark, sf_dir):
    return search.positions(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "tion")


@query(KMP_SQL)
def kmp_positions_chunked(spark, sf_dir):
    return search.rank_positions(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "tion", 8)


@query(f"""WITH {READS_SQL}, x AS (SELECT read_id, i::BIGINT - 1 AS pos, substr(s, i, 3) AS w FROM (SELECT read_id, s, unnest(range(1, length(s) - 1)) AS i FROM reads))
  SELECT read_id, pos FROM x WHERE w = 'GAT' AND pos // 24 = (pos + 2) // 24""")
def kmp_positions_split(spark, sf_dir):
    return search.rank_positions(reads(spark, sf_dir), "read_id", "s", "GAT", 4, overlap=False)


def _vector_edges(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("src"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2, F.expr("vec_id div 2"))).alias("dst"))


@query("""WITH e AS (SELECT vec_id AS src, unnest([vec_id + 1, vec_id + 2, vec_id // 2]) AS dst FROM embeddings),
  g AS (SELECT e.src, d.embedding FROM e JOIN embeddings d ON d.vec_id = e.dst),
  s AS (SELECT src, i, sum(embedding[i]::DOUBLE) AS t, count(*) AS n FROM g, range(1, 65) AS r(i) GROUP BY src, i)
  SELECT v.vec_id, (r.i - 1)::BIGINT AS dim, round(coalesce(s.t, 0) / (coalesce(s.n, 0) + 1e-8::DOUBLE), 5) AS value
  FROM embeddings v CROSS JOIN range(1, 65) AS r(i) LEFT JOIN s ON s.src = v.vec_id AND s.i = r.i""")
def gnn_mean(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    means = matrix.neighbour_mean(vectors, _vector_edges(vectors), "vec_id", "embedding", 64)
    return means.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))


# fixed values: genome types and sizes of the sample
GENOMES = [("Microbial", 2_000_000), ("Eukaryotic", 3_000_000_000), ("Pangenome", 12_000_000_000), ("SingleCellTranscriptomic", 500_000_000), ("HiCAssay", 1_000_000_000)]


@query("""WITH g AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Microbial' WHEN 1 THEN 'Eukaryotic' WHEN 2 THEN 'Pangenome'
    WHEN 3 THEN 'SingleCellTranscriptomic' ELSE 'HiCAssay' END AS genome_type, c_custkey * 1000003 AS n FROM customer),
  d AS (SELECT *, CASE genome_type WHEN 'Pangenome' THEN n // 1000 WHEN 'SingleCellTranscriptomic' THEN n // 2000 WHEN 'HiCAssay' THEN n // 500 END AS node_count FROM g)
  SELECT id, genome_type, node_count::BIGINT AS node_count, CASE WHEN node_count IS NULL THEN 'LinearIndex for genome of size: ' || n
    ELSE 'GraphIndex with ' || node_count || ' nodes, colored = ' || (genome_type = 'Pangenome') END AS description FROM d""")
def index_choice(spark, sf_dir):
    names = F.array(*[F.lit(g) for g, _ in GENOMES])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("genome_type"), (F.col("c_custkey") * 1000003).alias("approximate_size"))
    return matrix.describe_index(rows).select("id", "genome_type", "node_count", "description")


@query("""SELECT vec_id, (i - 1)::BIGINT AS dim, embedding[i] * 1.1::FLOAT AS cpu, embedding[i] * 2.0::FLOAT AS gpu, embedding[i] + 10.0::FLOAT AS fpga
  FROM embeddings, range(1, 65) AS r(i)""")
def accelerate(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    every = F.arrays_zip(*[S.scaled("embedding", b).alias(b) for b in ("cpu", "gpu", "fpga")])
    return vectors.select("vec_id", F.posexplode(every).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), "x.cpu", "x.gpu", "x.fpga")


@query("""WITH v AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS r, string_split(p_name, ' ')[2:] AS a FROM part),
  t AS (SELECT id, r || array_to_string(a, ',') AS x FROM v)
  SELECT id, len(list_filter(range(1, length(x)), lambda i: substr(x, i, 2) = 'ar'))::BIGINT AS hits FROM t""")
def vcf_alleles_motif(spark, sf_dir):
    """A part's first name word as reference, the others as alternatives."""
    names = F.split("p_name", " ")
    variants = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names[0].alias("ref"), F.slice(names, 2, F.size(names)).alias("alts"))
    return stats.variant_motif(variants, "ar").select("id", "hits")


@query(f"""SELECT r AS row, (('0x'||substr(md5(r||'#1'),1,15))::BIGINT % 2)::INT AS label,
  round(list_sum(list_transform(range(0, 10000), lambda i: ((('0x'||substr(md5(r||':'||i||'#0'),1,15))::BIGINT % 1000000) / 100000.0)::FLOAT::DOUBLE)), 3) AS total FROM range(0, 100) AS t(r)""")
def expression_matrix(spark, sf_dir):
    m = generators.expression_matrix(spark, 100, 10_000)
    return m.select("row", "label", F.round(F.aggregate("features", F.lit(0.0).cast("double"), lambda t, x: t + x.cast("double")), 3).alias("total"))


@query("SELECT r AS row, 64::BIGINT AS width, 64.0::DOUBLE AS total FROM range(0, 128) AS t(r)")
def constant_matrix(spark, sf_dir):
    m = generators.constant_matrix(spark, 128, 64)
    return m.select("row", F.size("features").cast("long").alias("width"), F.aggregate("features", F.lit(0.0).cast("double"), lambda t, x: t + x.cast("double")).alias("total"))


@query(f"""WITH {READS_SQL}, d AS (SELECT seq_id, pos FROM (SELECT read_id AS seq_id, unnest(range(0, length(s) - 1))::BIGINT AS pos FROM reads))
  SELECT seq_id, pos, pos + 1 AS nbr_pos FROM d ORDER BY seq_id, pos LIMIT 5""")
def mrf_first(spark, sf_dir):
    """The report's first five edges in order."""
    return graphs.chain_field(reads(spark, sf_dir), "read_id", "s").orderBy("seq_id", "pos").limit(5).select("seq_id", "pos", "nbr_pos")


@query(f"""WITH {_edges_sql(10, ', lang')}, g AS (SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS successors FROM e GROUP BY src)
  SELECT src, successors FROM g ORDER BY src LIMIT 5""")
def pangenome_first(spark, sf_dir):
    """The report's first five nodes in order, with their successors."""
    edges = graphs.pangenome(reads(spark, sf_dir), 10, "lang", "s")
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("successors")).orderBy("src").limit(5)


@query(f"""WITH {MINHASH_SQL} SELECT lang, array_to_string(list(min_hash ORDER BY seed), ',') AS signature FROM m WHERE seed < 5 GROUP BY lang""")
def minhash_first(spark, sf_dir):
    return sketches.first_minima(_minhash(spark, sf_dir), "lang", 5).select("lang", F.array_join("signature", ",").alias("signature"))


@query(f"""WITH h AS ({KMP_SQL}) SELECT doc_id, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM h GROUP BY doc_id""")
def kmp_position_lists(spark, sf_dir):
    lists = search.position_lists(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "tion")
    return lists.select("doc_id", F.array_join("positions", ",").alias("positions"))


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, 8)) AS chunk FROM d)
  SELECT doc_id, chunk::BIGINT AS chunk, (chunk * (n // 8))::BIGINT AS start, (CASE WHEN chunk = 7 THEN n ELSE (chunk + 1) * (n // 8) END)::BIGINT AS stop FROM c""")
def even_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(search.even_bounds(F.length(F.coalesce("text", F.lit(""))), 8)).alias("chunk", "b"))
    return docs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("b.start").alias("start"), F.col("b.end").alias("stop"))


@query(KMP_SQL)
def kmp_positions_even(spark, sf_dir):
    """By chunks of rounded-down size, the last one with the rest."""
    return search.rank_positions(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "tion", 8, even=True)


@query("""WITH p AS (SELECT n_nationkey, n_name AS p, unnest(range(1, length(n_name) + 1)) AS i FROM nation)
  SELECT n_nationkey, (i - 1)::BIGINT AS pos, list_max(list_filter(range(0, i), lambda b: substr(p, 1, b) = substr(p, i - b + 1, b)))::INT AS border FROM p""")
def pattern_borders(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(S.borders("n_name")).alias("pos", "border")).withColumn("pos", F.col("pos").cast("long"))


def dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts dealt to all cores: a table of one row group is one task, and windows are many times the text."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id").select("text")


@query("""WITH k AS (SELECT unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i+1] || l[i+2])) AS kmer FROM (SELECT string_split(text, '') AS l FROM documents WHERE text <> ''))
  SELECT kmer, count(*)::BIGINT AS n FROM k GROUP BY kmer""")
def text_windows(spark, sf_dir):
    """Windows of whole texts, which are as long as they come."""
    return graphs.windows(dealt_texts(spark, sf_dir), 3, "text").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i+1] || l[i+2])) AS w FROM (SELECT string_split(text, '') AS l FROM documents WHERE text <> ''))
  SELECT substr(w, 1, 2) AS src, substr(w, 2, 2) AS dst, count(*)::BIGINT AS n FROM k GROUP BY w""")
def text_edges(spark, sf_dir):
    return graphs.edge_counts(dealt_texts(spark, sf_dir), 2, "text")


from strandline.plans import files  # noqa: E402,F401  (registers its queries)
