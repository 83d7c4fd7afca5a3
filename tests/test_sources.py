from pyspark.sql import functions as F

from strandlake.config import SMALL
from strandlake.operators import consensus as con
from strandlake.operators import kmers as km
from strandlake.sources import formats as f
from strandlake.streaming import windows


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first one\nACG\nTT\n>r2\n\n>r3\tx\nGG\n")
    assert sorted(map(tuple, f.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("r1", "first one", "ACGTT"), ("r2", "", ""), ("r3", "x", "GG")]
    (tmp_path / "a.fq").write_text("@q1 d\nACGT\n+\n@III\n@q2\nGG\n+\nII\n")
    assert sorted(map(tuple, f.read_fastq(spark, str(tmp_path / "a.fq")).collect())) == [("q1", "d", "ACGT", "@III"), ("q2", "", "GG", "II")]
    d = spark.createDataFrame([("t", "A" * 250)], "tag string, seq string")
    d = f.fasta_lines(d)
    assert d.first().value.split("\n") == [">t", "A" * 100, "A" * 100, "A" * 50]


def test_overlap_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(0, "a"), (1, "b_c")], "ridx long, tag string")
    o = spark.createDataFrame([(0, 1, 20, 2, 18, 1, 17, 1, 16, 900, 15, 41, 2, "10M2mI3M")], "qidx long, qdir int, qlen int, qb int, qe int, tidx long, tlen int, tb int, te int, mat int, aln int, cnt int, gap int, cigar string")
    f.overlap_lines(o, reads, 256).write.text(str(tmp_path / "o"))
    again = f.overlaps_by_name(f.read_overlaps(spark, str(tmp_path / "o")), reads, 256)
    assert again.select(o.columns).collect() == o.collect()


def test_nodes_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(7, "x_1")], "ridx long, tag string")
    nodes = spark.createDataFrame([(3, False)], "node long, closed boolean")
    regs = spark.createDataFrame([(3, 7, 1, 4, 8, True)], "node long, rid long, dir int, beg int, end int, closed boolean")
    f.node_lines(regs, nodes, reads).write.text(str(tmp_path / "n"))
    assert tuple(f.read_nodes(spark, str(tmp_path / "n")).first()) == (3, False, "x_1", 1, 4, 8, True)


def test_layout_scan(spark, tmp_path):
    (tmp_path / "l").write_text(">ctg1 nodes=3 len=2304\nE\t0\tN10\t+\tN11\t-\nS\tr1\t+\t0\t4\tACGT\nS\tr2\t-\t5\t3\tACG\t0\t3\nE\t9\tN11\t-\tN12\t+\nS\tr3\t+\t0\t1\tA\n>ctg2\nE\t0\tN1\t+\tN2\t+\nS\tr4\t+\t0\t1\tC\n")
    got = [tuple(r) for r in f.read_layout(spark, str(tmp_path / "l")).orderBy("tag").collect()]
    assert got[1] == ("ctg1", 0, 0, 10, "+", 11, "-", "r2", "-", 5, 3, "ACG", 0, 3)
    assert [(r[0], r[1], r[7]) for r in got] == [("ctg1", 0, "r1"), ("ctg1", 0, "r2"), ("ctg1", 1, "r3"), ("ctg2", 0, "r4")]


def test_dot_round_trip_and_gfa(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, 2, 1, 7, -3, 0)], "node1 long, dir1 int, node2 long, dir2 int, cov int, off int, closed int")
    n = spark.createDataFrame([(1,), (2,)], "node long")
    f.dot_lines(n, e).coalesce(1).write.text(str(tmp_path / "d"))
    assert sorted(map(tuple, f.read_dot(spark, str(tmp_path / "d")).collect())) == [(1, 0, 2, 1, 7, -3), (2, 0, 1, 1, 7, -3)]
    assert [r.value.split("\t")[0] for r in f.gfa_lines(n, e, 4).collect()] == ["H", "S", "S", "L"]


def test_saved_index(spark):
    reads = spark.createDataFrame([(0, "a", "ACGTTGCAACGGTATC" * 30), (1, "b", "ACGTTGCAACGGTATC" * 30)], "ridx long, tag string, seq string")
    posted = km.index(reads, SMALL)
    f.save_index(posted, "seed_index", 4, k=15)
    assert f.load_index(spark, "seed_index", k=15).count() == posted.count()
    try:
        f.load_index(spark, "seed_index", k=16)
        raise AssertionError
    except ValueError:
        pass


def test_windows_of_a_stream_have_a_clock_for_each_name(spark, tmp_path):
    # b starts when a is far along; the last batch moves both beyond their windows, and brings a late read of a
    rows = [("a", k, 40 * k, 300 + k % 50) for k in range(200)] + [("b", 1000 + k, 40 * k, 350) for k in range(100)]
    late = [("a", 5000, 10, 400), ("a", 5001, 30_000, 1), ("b", 5002, 30_000, 1)]
    batches = [rows[:100], rows[100:200], rows[200:], late]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "name string, rid long, pos long, len long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("name string, rid long, pos long, len long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.window_depths(s, 500, 333, 1000).writeStream.format("memory").queryName("depths").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    streamed = sorted(map(tuple, spark.table("depths").collect()))
    whole = con.window_blocks(spark.createDataFrame(rows, "name string, rid long, pos long, len long"), 500, 333)
    assert streamed == sorted(map(tuple, whole.groupBy("name", "window").agg(F.count("*").alias("n"), F.sum("len").alias("letters")).collect()))
    assert len({x[0] for x in streamed}) == 2 and len(streamed) == len({x[:2] for x in streamed})


def test_stream_against_index(spark, tmp_path):
    seq = "ACGTTGCAACGGTATCCATG" * 20
    reads = spark.createDataFrame([(0, "a", seq), (1, "b", seq)], "ridx long, tag string, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    index = km.postings(km.kmers(reads, SMALL), km.kmer_counts(km.kmers(reads, SMALL)), SMALL)
    q = windows.query_index(s, index, SMALL).writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.tidx for r in spark.table("asked").collect()} == {0, 1}


def test_sequences_by_name(spark):
    seqs = spark.createDataFrame([("a_F_1_2", "ACGTT"), ("b", "AACCGGTT")], "tag string, seq string")
    wanted = spark.createDataFrame([("a_F_1_2",), ("b[+:1,4]",), ("b[-:1,4]",), ("b_R_0_3",), ("none",)], "name string")
    assert sorted(map(tuple, f.sequences_by_name(wanted, seqs).collect())) == [("a_F_1_2", "ACGTT"), ("b[+:1,4]", "ACC"), ("b[-:1,4]", "GGT"), ("b_R_0_3", "GTT")]
