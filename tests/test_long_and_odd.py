"""Long records in time that goes with their length, and files that are cut or broken."""

import json
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import graphs, matrix, search, sketches
from strandline.sources import readers, writers


def strand(n, seed=1):
    rnd = random.Random(seed)
    return "".join(rnd.choices("ACGT", k=n))


def test_windows_of_any_length(spark):
    texts = ["", "AC", "ACG", strand(255), strand(256), strand(257), strand(1_000), strand(1_024), strand(5_000), "é" * 600 + "𐀀b" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    for k in (1, 3, 64, 100, 300):
        got = sorted((r.id, r.pos, r.kmer, r.next) for r in graphs.windows(frame, k, keep=("id",)).collect())
        assert got == [(i, p, t[p : p + k], t[p + 1 : p + k + 1] if p + k < len(t) else None) for i, t in enumerate(texts) for p in range(len(t) - k + 1)]
        steps = sorted((r.id, r.pos, r.src, r.dst) for r in graphs.steps(frame, k, keep=("id",)).collect())
        assert steps == [x for x in got if x[3] is not None]
    assert graphs.windows(frame.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        graphs.windows(frame, 0)


def test_time_goes_with_the_length(spark):
    took = {}
    for n in (100_000, 1_000_000):
        frame = spark.createDataFrame([(0, strand(n))], "id long, seq string")
        graphs.edge_counts(frame, 21).count()
        began = time.perf_counter()
        assert graphs.edge_counts(frame, 21).agg(F.sum("n")).head()[0] == n - 21
        assert search.positions(frame, "id", "seq", "GATTACA").count() > n / 40_000
        took[n] = time.perf_counter() - began
    assert took[1_000_000] < 20 * took[100_000] + 5


def test_search_of_long_texts(spark):
    t = strand(9_000)
    frame = spark.createDataFrame([(0, t), (1, "a" * 3_000), (2, "")], "id long, seq string")
    for pattern in ("GA", t[1_020:1_030], t[10:1_500]):
        want = [i for i in range(len(t)) if t.startswith(pattern, i)]
        assert sorted(r.pos for r in search.positions(frame, "id", "seq", pattern).where("id = 0").collect()) == want
        for even in (False, True):
            assert sorted(r.pos for r in search.rank_positions(frame, "id", "seq", pattern, 7, even=even).where("id = 0").collect()) == want
    assert search.position_lists(frame, "id", "seq", "aa").head().positions == list(range(2_999))
    with pytest.raises(ValueError):
        search.positions(frame, "id", "seq", "")


def test_borders(spark):
    words = ["ABABABC", "aaaa", "x", "abcabcab", ""]
    got = {r.w: r.t for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", S.borders("w").alias("t")).collect()}
    assert got == {w: S.prefix_table(w) if w else [] for w in words}


def test_fasta_must_begin_with_a_header(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text("ACGTACGT\nGGG\n>x\nAC\n")
    with pytest.raises(ValueError, match="a.fa"):
        readers.read_fasta(spark, str(path))
    assert [(r.id, r.seq) for r in readers.read_fasta(spark, str(path), "DROPMALFORMED").collect()] == [("x", "AC")]
    (tmp_path / "empty.fa").write_text("")
    assert readers.read_fasta(spark, str(tmp_path / "empty.fa")).count() == 0


def test_fastq_over_many_splits(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i in range(3_000):
        n = rnd.randint(1, 60)
        rows.append((f"r{i}", strand(n, i), "".join(rnd.choices("@+I!5", k=n))))
    for name, part in (("a.fq", rows[:2_000]), ("b.fq", rows[2_000:])):
        (tmp_path / name).write_text("".join(f"@{i} x\n{s}\n+\n{q}\n" for i, s, q in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("777", "5000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.read_fastq_exact(spark, str(tmp_path)).drop("file")
            assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_that_is_cut_or_broken(spark, tmp_path):
    for k, text in enumerate(["@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n", "@r1\nACGT\n+\nIIII\n@r2\nGG\n", "@r1\nACGT\n+\nIIII\n@r2\nGG\nII\n@r3\nA\n+\n@\n", "r1\nACGT\n+\nIIII\n", "@r1\nACGT\n+\nIII\n"]):
        path = tmp_path / f"{k}.fq"
        path.write_text(text)
        with pytest.raises(PySparkException):
            readers.read_fastq_exact(spark, str(path)).collect()
        kept = [r.id for r in readers.read_fastq_exact(spark, str(path), "DROPMALFORMED").collect()]
        assert kept == [["r1"], ["r1"], ["r1", "r3"], [], []][k]


def test_fastx_whose_last_quality_starts_with_an_at(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(f"r{i}", strand(n := rnd.randint(1, 60), i), ("@" if i % 100 == 99 else rnd.choice("@+I!5")) + "".join(rnd.choices("@I", k=n - 1))) for i in range(1_200)]
    (tmp_path / "many").mkdir()
    for k in range(0, 1_200, 100):
        (tmp_path / "many" / f"{k}.fq").write_text("".join(f"@{i} x\n{s}\n+\n{q}\n" for i, s, q in rows[k : k + 100]))
    (tmp_path / "a.fa").write_text(">f\nAC\n")
    want = sorted([(i, s, None if q[0] == "@" else q) for i, s, q in rows] + [("f", "AC", None)], key=str)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("777", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.read_fastx(spark, [str(tmp_path / "a.fa"), str(tmp_path / "many")]).drop("file")
            assert sorted((tuple(r) for r in got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_ends_are_told_apart(spark, tmp_path):
    path = tmp_path / "a.fq"
    # text -> ids, and whether a record is malformed: blank lines and records without letters are sound, cut records are not
    for text, ids, broken in [
        ("\n\n@r1\nACGT\n+\n@III\n\n@r2\nG\n+\n@\n\n", ["r1", "r2"], False), ("@r1\n\n+\n\n@r2\n\n+\n\n", ["r1", "r2"], False), ("@r1\nA\n+\nI\n@r2\n", ["r1"], True),
        ("@r1\nA\n+\nI\n@r2\nG\n+", ["r1"], True), ("@r1\n@r2\nGG\n+\nII\n", ["r2"], True), ("@r1\nACGT\n+\n@II\n", [], True),
    ]:
        path.write_text(text)
        for read in (readers.read_fastq, readers.read_fastq_exact):
            assert [r.id for r in read(spark, str(path), "DROPMALFORMED").collect()] == ids
            if broken:
                with pytest.raises(PySparkException):
                    read(spark, str(path)).collect()
            else:
                assert read(spark, str(path)).count() == len(read(spark, str(path)).collect()) == len(ids)


def test_bloom_document_of_a_million_bits(spark):
    bits = spark.range(0, 40_000).select((F.col("id") * 25).alias("bit"))
    began = time.perf_counter()
    said = json.loads(writers.bloom_json(bits, 1_000_000, 3).head().value)
    assert said["size"] == 1_000_000 and [i for i, b in enumerate(said["bits"]) if b] == list(range(0, 1_000_000, 25))
    assert time.perf_counter() - began < 60


def test_json_array_in_files(spark, tmp_path):
    frame = spark.range(0, 500).select(F.col("id"), F.concat(F.lit("x\n"), F.col("id")).alias("t")).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_json_array(frame, "id", str(tmp_path / "j"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "j").glob("part-*"))
    whole = json.loads("".join(f.read_text() for f in files))
    assert len(files) > 1 and [r["id"] for r in whole] == list(range(500)) and whole[3]["t"] == "x\n3"


def test_successors_have_bounded_rows(spark):
    frame = spark.createDataFrame([(0, "AB" * 5_000)], "id long, seq string")
    assert {r.src: [tuple(x) for x in r.successors] for r in graphs.successor_counts(frame, 1).collect()} == {"A": [("B", 5_000)], "B": [("A", 4_999)]}


def test_strategies_can_be_added(spark):
    rows = spark.createDataFrame([("Phage", 5_000), ("Pangenome", 5_000)], "genome_type string, approximate_size long")
    got = matrix.describe_index(rows, strategies={"Phage": matrix.Graph(10)}).orderBy("genome_type").collect()
    assert [(r.node_count, r.is_colored, r.description) for r in got] == [(5, True, "GraphIndex with 5 nodes, colored = true"), (500, False, "GraphIndex with 500 nodes, colored = false")]


def test_first_minima(spark):
    sets = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "k string, i string")
    mins = sketches.minhash(sets, "k", "i", 9)
    assert sketches.first_minima(mins, "k", 4).head().signature == sketches.signature(mins, "k").head().signature[:4]
