"""Generators: the same on every run, and of the asked error rate."""

from helixframe.operators import simulate as M
from helixframe.operators.alignment import edit_distance


def test_noise_rate_and_repeatability():
    seq = "ACGTTGCA" * 100
    read, qual = M.noisy(seq, M.LEVELS[7], "1")
    assert (read, qual) == M.noisy(seq, M.LEVELS[7], "1") != M.noisy(seq, M.LEVELS[7], "2")
    assert len(read) == len(qual) and 0.03 < edit_distance(read, seq) / len(seq) < 0.12


def test_isoforms():
    assert M.isoforms(["AA", "C", "AA"]) == ["AACAA", "AAAA", "AAC", "CAA", "AA", "C"]
    a, b = M.isoform_pair(["AAA", "CCC", "GGG"], "exon")
    assert (a, b) == ("AAACCCGGG", "AAAGGG")
    a, b = M.isoform_pair(["AAA", "CCC", "GGG"], "snp")
    assert [i for i in range(9) if a[i] != b[i]] == [4]


def test_simulated_table(spark):
    df = spark.createDataFrame([("t1", "ACGT" * 20), ("t2", "GGCA" * 20)], "tx string, seq string")
    one, two = (sorted(map(tuple, M.simulate_reads(M.abundances(df, "constant", 3)).collect())) for _ in range(2))
    assert one == two and [x[0] for x in one] == ["t1_0", "t1_1", "t1_2", "t2_0", "t2_1", "t2_2"]
    exons = spark.createDataFrame([("c", "t", 4, 6), ("c", "t", 0, 2)], "chrom string, tx string, exon_start int, exon_end int")
    chrom = spark.createDataFrame([("c", "ACGTTG")], "chrom string, seq string")
    assert M.transcriptome(exons, chrom).first().seq == "ACTG"
