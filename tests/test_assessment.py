"""The per-read evaluation against plain loops, and the sources and sinks beside it."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignment as A
from helixframe.operators import assessment as S
from helixframe.operators import correction as C
from helixframe.operators import evaluation as E
from helixframe.operators import published, seeds, simulate
from helixframe.operators.correction import correct
from helixframe.plans.params import Params
from helixframe.sources import sequence_files as files
from tests.test_kernels import dna, naive, noisy_cluster


def test_alignment_lines(spark):
    df = spark.createDataFrame([("2S3M1I2M2D2M1S", "xxACGTTTaay", "ggACGTTCCAAtt", 2)], "c string, q string, t string, s int")
    r = df.select(S.alignment_lines(F.col("c"), F.col("q"), F.col("t"), F.col("s")).alias("l")).first().l
    assert (r.target_line, r.match_line, r.query_line) == ("ggACG-TTCCAAtt", "XX||| ||  ||XX", "xxACGTTT--aay-")


def test_same_isoform_and_chains(spark):
    reads = spark.createDataFrame([("a", "c", 1, 2), ("a", "c", 5, 9), ("b", "c", 1, 2), ("d", "c", 1, 2), ("d", "c", 5, 8)], "qname string, rname string, start int, stop int")
    known = spark.createDataFrame([("c", "t1", 1, 2), ("c", "t1", 5, 9), ("c", "t2", 1, 2)], "chrom string, tx string, start int, stop int")
    assert sorted(map(tuple, S.same_isoform(reads, known).collect())) == [("a", "t1"), ("b", "t2")]
    assert sorted((r.chain, r.confirmed) for r in S.novel_chains(reads, known).collect()) == [("1-2", True), ("1-2,5-8", False), ("1-2,5-9", True)]


def test_splice_ends_count_as_ends_of_either_kind(spark):
    known = spark.createDataFrame([("c", "t", 10, 20), ("c", "t", 30, 40)], "chrom string, tx string, start int, stop int")
    seen = spark.createDataFrame([("nic", "c", 20, 30), ("ism", "c", 10, 20), ("nnc", "c", 10, 21)], "qname string, rname string, start int, stop int")
    reads = spark.createDataFrame([("nic",), ("ism",), ("nnc",), ("none",)], "qname string")
    assert {r.qname: r["class"] for r in E.classify_splices(reads, seen, known).collect()} == {"nic": "NIC", "ism": "ISM", "nnc": "NNC", "none": "NO_SPLICE"}


def test_truth_and_ambiguity(spark):
    r = random.Random(4)
    refs = [(f"t{i}", dna(r, 40)) for i in range(5)]
    refs.append(("a-same", refs[2][1]))
    reads = [(i, refs[i % 5][1][5:35], refs[i % 5][1][6:30]) for i in range(10)] + [(50, dna(r, 12), dna(r, 9))]
    df, known = spark.createDataFrame(reads, "read int, raw string, made string"), spark.createDataFrame(refs, "tx string, seq string")
    infix = lambda p, t: min(naive(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    got = {x.read: (x.truth, x.raw_ed, x.made_ed) for x in S.truth_errors(df, known, "read", "raw", ["raw", "made"], "tx", "seq").collect()}
    for i, raw, made in reads[:3] + reads[-1:]:
        ed, name = min((infix(raw, s), n) for n, s in refs)
        assert got[i] == (name, ed, infix(made, dict(refs)[name]))
    assert got[2][0] == "a-same"
    two = df.withColumn("one", F.lit(refs[0][1])).withColumn("two", F.lit(refs[1][1]))
    kept = {x.read for x in S.unambiguous(two, "raw", "one", "two", 3).collect()}
    both = lambda a, b: min(infix(a, b), infix(b, a))
    assert kept == {i for i, raw, _ in reads if abs(both(raw, refs[0][1]) - both(raw, refs[1][1])) >= 3}


def test_tie_refinement_and_profiles(spark):
    tied = spark.createDataFrame([("q", "x"), ("q", "y")], "acc string, ref string")
    reads = spark.createDataFrame([("q", "ACGTACGTACGT")], "acc string, seq string")
    refs = spark.createDataFrame([("x", "ACGTACGTACGA"), ("y", "ACGTTACGTACGT")], "ref string, seq string")
    assert [(r.ref, r["del"] + r.ins + r.subs) for r in S.refined(tied, reads, refs, "acc", "ref", "seq").collect()] == [("y", 1)]  # free ends make x two gaps
    df = spark.createDataFrame([("AACGT", "ACGTT"), ("ACGT", "ACGT")], "s string, t string")
    out = S.profiled(df, "s", "t").collect()
    assert [(x.err, x.subs + x.ins + x["del"], x.matches) for x in out] == [(2, 2, 4), (0, 0, 4)] and out[1].err_rate == 0


def test_blocks(spark):
    df = spark.createDataFrame([(1, "AAAA" + "-" * 11 + "CCCC", "AAAA" + "G" * 11 + "CCCC"), (2, "AAAA" + "-" * 11, "AAAA" + "G" * 11)], "k int, query_aln string, target_aln string")
    assert [tuple(r) for r in S.gap_blocks(df, "k").collect()] == [(1, 4, 15)]
    inside = {r.pos for r in S.match_blocks(df, "k", 3, 4).filter("k = 1 and inside").collect()}
    assert inside == {0, 1, 2, 3, 15, 16, 17, 18}


def test_cached_annotation_accessions_and_observation(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("c", "t", 1, 2)], "chrom string, tx string, start long, stop long")

    for _ in range(2):
        assert [tuple(r) for r in files.annotation(spark, f"{tmp_path}/ann", make).collect()] == [("c", "t", 1, 2)]
    assert len(made) == 1
    with pytest.raises(Exception):  # noqa: B017
        files.annotation(spark, f"{tmp_path}/none")
    (tmp_path / "a.gff").write_text("x transcript:T1;y transcript:T2\nz\ntranscript:T1\n")
    assert sorted(r.acc for r in files.read_accessions(spark, f"{tmp_path}/a.gff").collect()) == ["T1", "T2"]
    (tmp_path / "a.fa").write_text(">(t1),x y\nAC\n")
    assert files.read_sequences(spark, f"{tmp_path}/a.fa", "clean").first().acc == "t1x"
    df = spark.createDataFrame([("ACGT",), ("AXX",), (None,)], "seq string")
    rows, seen = files.observed(df, "reads")
    rows.count()
    assert seen.get == {"reads": 3, "bases": 7, "odd": 1}
    results = spark.createDataFrame([("t", "x", 3, 1)], "transcript string, type string, depth int, more int")
    files.write_results(results, f"{tmp_path}/csv", "aligned_coverage")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["transcript", "type", "depth"]


def test_batches_joined_by_name(spark, tmp_path):
    reads = spark.createDataFrame([(1, i, f"r{i}", "A", "+") for i in range(1, 25)], "cluster_id int, r_id int, acc string, seq string, qual string")
    files.write_fastq(reads.coalesce(1), f"{tmp_path}/o", by_name=2)
    got = [r.value for r in spark.read.text(f"{tmp_path}/o/cluster_id=1").collect() if r.value.startswith("@")]
    assert got[:6] == ["@r1", "@r2", "@r3", "@r4", "@r21", "@r22"]


def test_affine_from_end_to_end():
    r = random.Random(8)
    for _ in range(150):
        a, b = dna(r, r.randint(0, 7)), dna(r, r.randint(0, 7))
        score, x, y = A.affine(a, b, 2, -3, 4, 1)
        assert x.replace("-", "") == a and y.replace("-", "") == b
        rate, gap = 0, None
        for p, q in zip(x, y, strict=True):
            kind = "b" if p == "-" else "a" if q == "-" else None
            rate += (2 if p == q else -3) if kind is None else (-1 if kind == gap else -4)
            gap = kind
        assert rate == score
        best = {}

        def top(i, j, last, a=a, b=b, best=best):
            if (i, j, last) not in best:
                out = [0] if i == len(a) and j == len(b) else []
                if i < len(a) and j < len(b):
                    out.append((2 if a[i] == b[j] else -3) + top(i + 1, j + 1, None))
                if i < len(a):
                    out.append((-1 if last == "a" else -4) + top(i + 1, j, "a"))
                if j < len(b):
                    out.append((-1 if last == "b" else -4) + top(i, j + 1, "b"))
                best[i, j, last] = max(out)
            return best[i, j, last]

        assert score == top(0, 0, None)


def test_runs_of_spans():
    r = random.Random(3)
    for _ in range(300):
        spans = [(s, s + r.randint(0, 6), 1, "") for s in (r.randint(0, 40) for _ in range(r.randint(0, 8)))]
        covered = sorted({x for a, b, *_ in spans for x in range(a, b)})
        want, n = {}, 0
        for i, x in enumerate(covered):
            n += i > 0 and x > covered[i - 1] + 1
            want[x] = n
        runs = C.Runs(spans)
        assert [runs.at(x) for x in range(50)] == [want.get(x) for x in range(50)]


def test_minimizers_equal_a_rescan_of_every_window():
    def plain(seq, k, w):
        span = w - k
        window = [(seq[i : i + k], i) for i in range(span + 1)]
        current = max((x for x in window if x[0] == min(window)[0]), key=lambda x: x[1])
        out = [current]
        for i in range(span + 1, len(seq) - k):
            gone, window = window[0], [*window[1:], (seq[i : i + k], i)]
            if gone[0] == current[0] and current[1] < i - span:
                least = min(x[0] for x in window)
                current = [x for x in window if x[0] == least][-1]
                out.append(current)
            elif window[-1][0] < current[0]:
                current = window[-1]
                out.append(current)
        return out

    r = random.Random(7)
    for _ in range(800):
        seq = "".join(r.choice("AC") for _ in range(r.randint(0, 40)))
        k = r.randint(1, 4)
        w = r.randint(k, k + 6)
        assert seeds.minimizers(seq, k, w) == plain(seq, k, w)


def test_anchor_counts_equal_the_array_form(spark):
    r = random.Random(9)
    rows = [("c" if i % 3 else None, i, "".join(r.choice("AAACGTN") for _ in range(r.randint(0, 150)))) for i in range(30)] + [("d", 90, None), ("d", 91, "A" * 60)]
    df = spark.createDataFrame(rows, "cluster_id string, r_id int, seq string").repartition(3)
    mins = F.transform(seeds.window_minimizer_array(F.col("seq"), 5, 9), lambda m: F.struct(m["kmer"].alias("kmer"), (-m["neg"]).alias("pos")))
    pairs = seeds.exploded_pairs(df.select("cluster_id", "r_id", mins.alias("minimizers")), 10, 30, 5)
    want = pairs.groupBy("cluster_id", "m1", "m2").agg(F.count("*").alias("occurrences"), F.count_distinct("r_id").alias("reads"))
    got = seeds.anchor_counts(df, 5, 9, 10, 30)
    key = lambda x: sorted(map(tuple, x.select("cluster_id", "m1", "m2", "occurrences", "reads").collect()), key=repr)
    assert key(got) == key(want)


def test_exact_correction_in_slices_and_without_sequences(spark):
    _, reads = noisy_cluster(reads=10)
    rows = [(1, i, f"r{i}", s, "5" * len(s)) for i, s in enumerate(reads, 1)] + [(1, 11, "none", None, None), (None, 1, "alone", "ACGT", None)]
    df = spark.createDataFrame(rows, "cluster_id int, r_id int, acc string, seq string, qual string")
    one = sorted(map(tuple, correct(df, Params(exact=True)).collect()), key=repr)
    assert sorted(map(tuple, correct(df, Params(exact=True), slices=3).collect()), key=repr) == one and len(one) == 12
    assert (1, 11, "none", None, None) in one and (None, 1, "alone", "ACGT", "++++") in one
    with pytest.raises(ValueError, match="exact"):
        correct(df, slices=2)
    assert correct(df.limit(0)).count() == 0
    assert [x[1] for x in C.correct_batch([1, 2, 3], reads[:3], [None] * 3, Params(aligner="affine"), True)]


def test_generators(spark):
    tx = spark.createDataFrame([(f"t{i}", "ACGT" * 30) for i in range(400)], "tx string, seq string")
    counts = lambda model: {r.n for r in simulate.abundances(tx, model, 3 if model == "uniform" else 1).collect()}
    assert counts("weighted") <= set(simulate.COUNTS) and len(counts("weighted")) > 5 and counts("exponential") == {2**i for i in range(8)}
    mean = simulate.abundances(tx, "uniform", 3).agg(F.avg("n")).first()[0]
    assert 2.5 < mean < 3.5
    family = simulate.gene_family(["ACGTACGTAC" * 5, "TTGCA" * 8], 6, 0.1)
    assert len(family) == 6 and family == simulate.gene_family(["ACGTACGTAC" * 5, "TTGCA" * 8], 6, 0.1) and len({tuple(g) for g in family}) > 2
    whole, gap = simulate.isoform_pair(["ACGT" * 20, "TTGC" * 20], "gap-near")
    assert len(gap) == len(whole) - 1 and simulate.isoform_pair(["ACGT" * 20], "snp-near")[1] != "ACGT" * 20
    read, qual = simulate.noisy("ACGT" * 200, simulate.LEVELS[12], "s")
    assert len(read) == len(qual) and read != "ACGT" * 200 and simulate.noisy("ACGT" * 200, simulate.LEVELS[12], "s") == (read, qual)


def test_accuracy_of_sets_parses_alignments_once(spark):
    """Errors come from the CIGAR where there is no nm; reads without a name or missing in a set don't count; aggregates read what was written."""
    rows = [("o", 1, 0, 0, "8=2X"), ("o", 1, 1, 0, "1=9X"), ("c", 1, 5, 256, "10X"), ("c", 1, 6, 0, "9=1I2D"), ("o", 2, 0, 0, "10="), ("o", None, 0, 0, "10="), ("c", None, 0, 0, "10="), ("o", 3, 0, 0, "5S"), ("c", 3, 0, 0, "5=")]
    df = spark.createDataFrame(rows, "set string, read long, ord long, flag int, cigar string")
    whole = published.genome_accuracy(df, 2)
    assert {r["set"]: (r["n"], r.err_mean, r.aln_mean, r.err_total) for r in whole.collect()} == {"o": (1, 20.0, 100.0, 20.0), "c": (1, 30.0, 100.0, 30.0)}
    paired = published.paired_accuracy(df, "o", 2)
    assert list(map(tuple, paired.collect())) == [("c", 10.0, 0, 1, 0)]
    for made in (whole, paired):
        assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    given = published.paired_accuracy(df.withColumn("nm", F.lit(3)), "o", 2)
    assert list(map(tuple, given.collect())) == [("c", 0.0, 0, 0, 1)]
