"""File sources and sinks, spark-side correction, streaming, SQL functions."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import cigar, sequences
from helixframe.operators import evaluation as E
from helixframe.operators import seeds
from helixframe.operators.correction import correct
from helixframe.operators.udfs import register
from helixframe.plans.params import Params
from helixframe.sources import sequence_files as S
from helixframe.streaming import correct_stream
from tests.test_kernels import noisy_cluster


def test_parser_cases():
    text = "@a b\nAC\nGT\n+\n!!\n@!\n>f x\nAA\nC\n@cut\nACGT\n+\n!!"
    assert list(S.parse(text.split("\n"))) == [("a_b", "ACGT", "!!@!"), ("f_x", "AAC", None), ("cut", "ACGT", None)]
    assert list(S.parse([])) == []


@pytest.fixture
def folder(tmp_path):
    _, reads = noisy_cluster(reads=8)
    for c in (3, 12):
        (tmp_path / f"{c}.fastq").write_text("".join(f"@r {i}\n{s}\n+\n{'5' * len(s)}\n" for i, s in enumerate(reads)))
    return tmp_path


def test_fastq_round_trip(spark, folder, tmp_path):
    reads = S.read_clusters(spark, str(folder))
    assert sorted({(r.cluster_id, r.r_id) for r in reads.collect()}) == [(c, i) for c in (3, 12) for i in range(1, 9)]
    four = S.read_fastq4(spark, f"{folder}/*.fastq")
    assert four.select("r_id", "acc", "seq", "qual").exceptAll(reads.select("r_id", "acc", "seq", "qual")).count() == 0
    S.write_fastq(reads, f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out/cluster_id=3").collect()
    assert len(back) == 32 and back[0].value == "@r_0"
    assert S.unfinished(reads, reads.filter("cluster_id = 3")).select("cluster_id").distinct().collect()[0][0] == 12


def test_sam_and_gff(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t0\tchr1\t11\t60\t5=1X2I4=\t*\t0\t0\tACGTACGTACGT\t*\tNM:i:3\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\nq1\t256\tchr1\t1\t0\t3=\t*\t0\t0\tACG\t*\n")
    assert S.read_sam(spark, f"{tmp_path}/a.sam").count() == 2
    row = S.read_sam(spark, f"{tmp_path}/a.sam", True).first()
    assert (row.qname, row.start, row.nm) == ("q1", 10, 3)
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\texon\t1\t50\t.\t+\t.\tgene_id "g"; transcript_id "t";\nchr1\ts\texon\t101\t150\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    exons = S.read_gff(spark, f"{tmp_path}/a.gtf")
    assert [tuple(r) for r in E.introns_of(exons).collect()] == [("chr1", "t", 50, 100)]


def test_cigar_expansion(spark):
    df = spark.createDataFrame([("2=1X1I1D1=", "ACTGA", "ACGTA")], "c string, q string, t string")
    r = df.select(cigar.gapped(F.col("c"), F.col("q"), F.col("t")).alias("g")).first().g
    assert (r.query_aln, r.target_aln) == ("ACTG-A", "ACG-TA")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("AACCG", "!5I")], "s string, q string")
    r = df.select(sequences.compress_homopolymers(F.col("s")).alias("h"), sequences.reverse_complement(F.col("s")).alias("r"), sequences.quality_prefix(F.col("q")).alias("p")).first()
    assert (r.h, r.r, len(r.p), r.p[1]) == ("ACG", "CGGTT", 4, 0.79433)


def test_exact_minimizers_equal_window_form_without_ties(spark):
    _, reads = noisy_cluster(reads=4)
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(reads)], "cluster_id int, r_id int, seq string")
    exact = {(r.r_id, m.pos) for r in seeds.with_minimizers(df, 9, 20).collect() for m in r.minimizers}
    window = {(r.r_id, r.pos) for r in seeds.window_minimizers(df, 9, 20).collect()}
    assert len(exact ^ window) <= 0.1 * len(exact)


def test_correct_is_independent_of_partitioning(spark):
    _, reads = noisy_cluster(reads=12)
    df = spark.createDataFrame([(c, i + 1, f"r{i}", s, "5" * len(s)) for c in (1, 2) for i, s in enumerate(reads)], "cluster_id int, r_id int, acc string, seq string, qual string")
    a, b = (sorted(map(tuple, correct(df.repartition(n), Params(batch_size=6)).collect())) for n in (1, 5))
    assert a == b and len(a) == 24 and all(set(r[4]) == {"+"} for r in a)


def test_streamed_clusters(spark, folder, tmp_path):
    correct_stream(spark, str(folder), f"{tmp_path}/done", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/done").count() == 16


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select edit_path('ACGT', 'AGT').cigar as c").first().c == "1=1I2="
    assert spark.sql("select infix_distance('CG', 'ACGT') as d").first().d == 0
    assert spark.sql("select count(*) as n from anchors('ACGTACGTTTGACCAGTAGGACCATTGACCAGTAAGGCAT', 5, 8, 10, 30)").first().n > 0


def test_redundancy_and_nearest(spark):
    df = spark.createDataFrame([(1, "ACGTACGTACGTACGTACGT"), (2, "GTACGTACGTACGTACG"), (3, "ACGTACGTACGTACGTACGT"), (4, "TAC"), (5, "")], "k int, s string")
    assert sorted(r.k for r in E.redundant(df, "k", "s").collect()) == [2, 3, 4]
    refs = spark.createDataFrame([(7, "ACGA"), (8, "TTTT"), (9, "ACGC")], "ref int, rs string")
    one = spark.createDataFrame([(1, "ACGT"), (2, None)], "k int, s string")
    assert [tuple(r) for r in E.nearest(one, refs, "k", "ref", "s", "rs").collect()] == [(1, 7, 1)]
    tied = E.nearest(one, refs, "k", "ref", "s", "rs", ties=True)
    assert sorted(tuple(r) for r in tied.collect()) == [(1, 7, 1), (1, 9, 1)]


def test_redundancy_of_reverse_complements(spark):
    long = "AACCTGACTTGACCATAGGACCATTGACC"
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, long), (2, rc(long[3:25])), (3, rc(long[5:11])), (4, rc(long)), (5, long[2:20]), (6, "GGGGGGGGGGGGGGGGGGGG")]
    df = spark.createDataFrame(rows, "k int, s string")
    assert sorted(r.k for r in E.redundant(df, "k", "s").collect()) == [2, 3, 4, 5]
    assert sorted(r.k for r in E.redundant(df, "k", "s", both_strands=False).collect()) == [2, 3, 5]  # 2 and 3 are in 4 as they are
