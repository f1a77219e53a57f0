"""Known results of the capabilities that are matched, with fixture rows inlined."""

import gzip
import json
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import graphs, matrix, search, sketches, stats, suffix
from strandline.plans import flows
from strandline.sources import generators, readers, writers
from strandline.streaming import edges

READS = ["AGCTAGCTAGCTAGCTAGCTAGCTAGCTAG", "TGCATGCATGCATGCATGCAATGCATGC", "CGTACGTACGTACGTACTGAGGCTAGCTG"]
HAPLOTYPES = ["ATCGATCGATCGATCGATCG", "CGTACGTACGTACGTACGTA", "GATCGATCGATCGATCGTAC", "TACGTAGCTAGCTAGCTAGC", "ACGTACGTAGCTAGCTAGCT", "CGTACGATCGTACGTAGCTA"]


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")


def test_multigraph_nodes(spark):
    reads = frame(spark, READS)
    assert graphs.source_nodes(reads, 21).count() == 19
    assert graphs.all_nodes(reads, 21).count() == 21
    counted = graphs.edge_counts(reads, 21)
    assert (counted.count(), counted.agg(F.sum("n")).head()[0]) == (19, 24)


def test_pangenome(spark):
    reads = frame(spark, HAPLOTYPES).withColumn("hap", F.expr("concat('h', id div 2)"))
    assert graphs.source_nodes(reads, 10).count() == 29
    found = {r.src: r.successors for r in graphs.adjacency(reads, 10).collect()}
    assert found["CGTAGCTAGC"] == ["GTAGCTAGCT"] * 2 and found["ATCGTACGTA"] == ["TCGTACGTAG"]
    assert graphs.pangenome(reads, 10, "hap").agg(F.sum("n")).head()[0] == 60


def test_chain_field(spark):
    assert graphs.chain_field(frame(spark, ["ATCGTACGTA", "GCTAGCTAGC", "TTAGCGATCG", "A", ""]), "id").count() == 27


def test_partial_graph(spark):
    read = "ACGGAGGATGCGAGCGTTATCCGGATTTATTGGGTT"
    row = graphs.partial_graphs(frame(spark, [read]), 31, "id").head()
    assert row.nodes == [read[i : i + 31] for i in range(6)] and row.edges == [[i, i + 1] for i in range(5)] and row.k == 31


def test_simple_graph_keeps_ends(spark):
    got = {r.kmer: r.edges for r in graphs.simple_graph(frame(spark, ["ACGT", "ACGA", "AC"]), 2).collect()}
    assert got == {"AC": ["CG"], "CG": ["GA", "GT"], "GT": [], "GA": []}


@pytest.mark.parametrize("run", [suffix.short_suffix_arrays, suffix.long_suffix_arrays])
def test_suffix_arrays(spark, run):
    genome = "ATGCGTACGTTAGCAGT" + "CGTACGTAGCTAGCTAGC" + "GCTAGCTAGTGCATGCA"
    texts = spark.createDataFrame([(0, "GATTACAGATTACACAT"), (1, genome), (2, "aaaaéaaa𐐀aa"), (3, "")], "id long, t string")
    got = {}
    for r in run(texts, "id", "t").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.pos)
    assert got[0] == [11, 4, 13, 6, 15, 8, 1, 12, 5, 14, 7, 0, 16, 10, 3, 9, 2]
    assert got[1][:10] == [51, 20, 6, 11, 32, 28, 24, 38, 14, 42]
    assert got[2] == sorted(range(11), key=lambda i: "aaaaéaaa𐐀aa"[i:].encode()) and 3 not in got


def test_chunk_suffix_array(spark):
    texts = spark.createDataFrame([(0, "ATGCGTACGTAGCTAGCTAGCTAGCTAGCTAGC")], "id long, t string")
    want = [6, 30, 26, 22, 18, 14, 10, 0, 32, 3, 7, 28, 24, 20, 16, 12, 31, 2, 27, 23, 19, 15, 11, 4, 8, 5, 29, 25, 21, 17, 13, 9, 1]
    assert [r.pos for r in suffix.chunk_suffix_arrays(texts, "id", "t").orderBy("rank").collect()] == want
    assert suffix.chunk_suffix_arrays(texts, "id", "t", 10).count() == 33


def test_stats(spark):
    got = stats.record_stats(frame(spark, ["ATGCGATCGATCGA", "GCTAGCTAGC", "", None])).orderBy("id").collect()
    assert [(r.seq_len, r.gc_count) for r in got] == [(14, 7), (10, 6), (0, 0), (None, None)]
    assert stats.letter_total(frame(spark, ["ATGCGATCGATCGA"])).head()[0] == 0
    assert stats.motif_total(frame(spark, ["AAAA", "GATTACA"]), "AA").head() == (2, 3)
    with pytest.raises(ValueError):
        S.occurrences("seq", "")


def test_variant_seam(spark):
    v = spark.createDataFrame([("GATT", ["ACA"]), ("G", ["GATTACA", "T"])], "ref string, alts array<string>")
    assert [r.hits for r in stats.variant_motif(v, "GATTACA").collect()] == [1, 1]
    assert [r.hits for r in stats.variant_motif(v, "GATTACA", per_allele=True).collect()] == [0, 1]


def test_search(spark):
    t = spark.createDataFrame([(0, "ABABABCAABABABABCABABABCA")], "id long, t string")
    at = lambda f: sorted(r.pos for r in f.collect())
    assert at(search.positions(t, "id", "t", "ABABABC")) == [0, 10, 17]
    for n, lost in ((2, [0, 17]), (3, [0, 10]), (4, [0]), (5, [])):
        assert at(search.rank_positions(t, "id", "t", "ABABABC", n)) == [0, 10, 17]
        assert at(search.rank_positions(t, "id", "t", "ABABABC", n, overlap=False)) == lost
    assert at(search.rank_positions(t, "id", "t", "ABABABC", 8)) == [0, 10, 17]
    assert S.prefix_table("ABABABC") == [0, 0, 1, 2, 3, 4, 0]


@settings(max_examples=15, deadline=None)
@given(text=st.text("ab.", max_size=40), pattern=st.text("ab.", min_size=1, max_size=3), chunk=st.integers(1, 9))
def test_search_any(spark, text, pattern, chunk):
    t = spark.createDataFrame([(0, text)], "id long, t string")
    want = [i for i in range(len(text)) if text.startswith(pattern, i)]
    assert sorted(r.pos for r in search.chunk_positions(t, "id", "t", pattern, chunk).collect()) == want


def test_bloom_and_minhash(spark):
    items = generators.random_dna(spark, 500, 20)
    bits = sketches.bloom_bits(items, "seq")
    assert sketches.bloom_probe(items, "read_id", "seq", bits).where("not maybe").count() == 0
    other = generators.random_dna(spark, 500, 20, seed=1)
    assert sketches.bloom_probe(other, "read_id", "seq", bits).where("maybe").count() < 25
    ones = sketches.bloom_bitmap(bits).agg(F.sum(F.bitmap_count("bitmap"))).head()[0]
    assert ones == bits.count()
    sets = items.select(F.lit("x").alias("k"), "seq").unionByName(items.select(F.lit("y").alias("k"), "seq")).unionByName(other.select(F.lit("z").alias("k"), "seq"))
    got = {(r.a, r.b): r.jaccard for r in sketches.jaccard(sketches.minhash(sets, "k", "seq", 20), "k").collect()}
    assert got["x", "y"] == 1 and got["x", "z"] < 0.1
    assert len(sketches.signature(sketches.minhash(sets, "k", "seq", 20), "k").head().signature) == 20


def test_matrix(spark):
    nodes = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "id long, f array<float>")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 0)], "src long, dst long")
    got = {r.id: [round(x, 5) for x in r.f] for r in matrix.neighbour_mean(nodes, links, "id", "f", 2).collect()}
    assert got == {0: [4.0, 5.0], 1: [1.0, 2.0], 2: [0.0, 0.0]}
    assert matrix.propagate(nodes, links, "id", "f", 2, 2).count() == 3
    scaled = spark.sql("select array(1f, 2f, 3f, 4f, 5f) v").select(S.scaled("v"), S.scaled("v", "gpu"), S.scaled("v", "fpga")).head()
    assert [f"{x:.8g}" for x in scaled[0]][:2] == ["1.1", "2.2"] or [round(x, 5) for x in scaled[0]] == [1.1, 2.2, 3.3, 4.4, 5.5]
    genomes = spark.createDataFrame([("Microbial", 2_000_000), ("Pangenome", 12_000_000_000), ("SingleCellTranscriptomic", 500_000_000), ("HiCAssay", 1_000_000_000), ("?", 1)], "genome_type string, approximate_size long")
    text = [r.description for r in matrix.describe_index(genomes).collect()]
    assert text == ["LinearIndex for genome of size: 2000000", "GraphIndex with 12000000 nodes, colored = true", "GraphIndex with 250000 nodes, colored = false", "GraphIndex with 2000000 nodes, colored = false", None]


def test_readers(spark, tmp_path):
    fa, fq, sam, vcf = (tmp_path / n for n in ("a.fa", "a.fq", "a.sam", "a.vcf"))
    fa.write_text(">seq1 first > one\r\nAGCTGCGCGG\r\nATCAGCGT\r\n>seq2\nCGTAGCTAGGCTAGGCTA\n")
    got = readers.read_fasta(spark, str(fa))
    assert [(r.id, r.seq) for r in got.collect()] == [("seq1", "AGCTGCGCGGATCAGCGT"), ("seq2", "CGTAGCTAGGCTAGGCTA")]
    rows = stats.record_stats(got).select("id", "seq_len", "gc_content")
    assert json.loads(writers.json_array(rows, "id").head()[0]) == [{"id": "seq1", "seq_len": 18, "gc_content": 0.6666666666666666}, {"id": "seq2", "seq_len": 18, "gc_content": 0.5555555555555556}]
    fq.write_text("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    assert [(r.id, r.seq, r.qual) for r in readers.read_fastx(spark, str(fq)).collect()] == [("r1", "ACGT", None), ("r2", "GG", "II")]
    assert [r.qual for r in readers.read_fastq_exact(spark, str(fq)).collect()] == ["@III", "II"]
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(fa.read_bytes()))
    assert readers.read_fastx(spark, [str(tmp_path / "b.fa.gz"), str(fq)]).count() == 4
    bad = tmp_path / "bad.fq"
    bad.write_text("@r1\nACGT\n+\nI\n@r2\nGG\n+\nII\n")
    assert readers.read_fastq(spark, str(bad), "DROPMALFORMED").count() == 1
    with pytest.raises(PySparkException):
        readers.read_fastq(spark, str(bad)).collect()
    sam.write_text("@HD VN:1.0\nseq1    0   seq1    1   60  10M  *   0   0   AGCTAGCTAG   IIIIIIIIII\n")
    assert readers.read_sam(spark, str(sam), lenient=True).head().seq == "AGCTAGCTAG"
    assert readers.read_sam(spark, str(sam), "DROPMALFORMED").count() == 0
    vcf.write_text("##x\n#CHROM\nc1\t5\t.\tGATT\tACA,T\t.\tPASS\t.\n")
    assert readers.read_vcf(spark, str(vcf)).head().alts == ["ACA", "T"]
    assert readers.flatten_fasta(spark, str(fa)).head().text == "AGCTGCGCGGATCAGCGTCGTAGCTAGGCTAGGCTA"
    assert readers.read_whole(spark, str(tmp_path / "none"), "ABAB").head().text == "ABAB"
    assert sorted(r.ordinal for r in readers.with_ordinal(got.repartition(2)).collect()) == [0, 1]
    assert readers.download(fa.as_uri(), str(tmp_path / "copy")) == fa.stat().st_size


def bgzf(data):
    out = b""
    for part in (data, b""):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_binary_readers(spark, tmp_path):
    seq = bytes([0x41, 0x88])  # GATT
    body = struct.pack("<iiBBHHHi", 0, 9, 3, 60, 0, 1, 4, 4) + struct.pack("<iii", -1, -1, 0) + b"r1\0" + struct.pack("<I", 4 << 4) + seq + bytes([40] * 4)
    bam = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(bgzf(bam))
    r = readers.read_bam(spark, str(tmp_path / "a.bam")).head()
    assert (r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual) == ("r1", 4, "c1", 10, "4M", "GATT", "IIII")
    head = b"##fileformat=VCFv4.2\n##contig=<ID=c1,length=100>\n\0"
    text = lambda s: bytes([len(s) << 4 | 7]) + s
    shared = struct.pack("<iiifII", 0, 9, 1, 0.0, 3 << 16, 0) + text(b"v1") + text(b"GATT") + text(b"ACA") + text(b"T") + b"\0"
    (tmp_path / "a.bcf").write_bytes(bgzf(b"BCF\2\2" + struct.pack("<I", len(head)) + head + struct.pack("<II", len(shared), 0) + shared))
    r = readers.read_bcf(spark, str(tmp_path / "a.bcf")).head()
    assert (r.chrom, r.pos, r.id, r.ref, r.alts) == ("c1", 10, "v1", "GATT", ["ACA", "T"])


def test_flows_and_writers(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r\nGATTACA\n+\nIIIIIII\n")
    assert flows.graph_and_filter(spark, str(tmp_path / "a.fq"), str(tmp_path / "o1")) == {"nodes": 0, "size": 1_000_000, "num_hashes": 3, "probe": False}
    assert flows.graph_and_filter(spark, str(tmp_path / "a.fq"), str(tmp_path / "o2"), 4, "ATTA")["probe"]
    (tmp_path / "g.fa").write_text(">x\nATGCG\nTACG\n")
    assert json.loads(flows.partial_arrays_json(spark, str(tmp_path / "g.fa"), 5).head()[0])[1]["start_pos"] == 5
    assert flows.parse_k("x") == 31 and flows.parse_k("7") == 7
    m = generators.expression_matrix(spark, 3, 5)
    writers.write_lines(writers.matrix_lines(m), str(tmp_path / "csv"))
    assert len(spark.read.text(str(tmp_path / "csv")).head()[0].split(",")) == 6
    bits = spark.createDataFrame([(1,), (3,)], "bit long")
    assert json.loads(writers.bloom_json(bits, 5, 2).head()[0]) == {"bits": [False, True, False, True, False], "num_hashes": 2, "size": 5}
    assert json.loads(writers.json_object(graphs.simple_graph(frame(spark, ["ACG"]), 2), "kmer", "edges").head()[0]) == {"AC": ["CG"], "CG": []}
    assert generators.constant_matrix(spark, 2, 3).head().features == [1.0, 1.0, 1.0]


def test_edge_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        frame(spark, READS[n : n + 1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, seq string").parquet(str(tmp_path / "in"))
        edges.append_edges(stream, 5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.src, r.dst): r.n for r in edges.total_edges(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.src, r.dst): r.n for r in graphs.edge_counts(frame(spark, READS[:2]), 5).collect()}
