"""What a task holds or hands on is bounded, and results don't depend on the bound."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import seeds


def texts(n=40, size=400, seed=5):
    r = np.random.default_rng(seed)
    return [("x" if i % 3 else "y" if i % 2 else None, i, "".join("ACGT"[j] for j in r.integers(0, 4, size)) if i % 7 else None if i else "A" * size) for i in range(n)]


def anchors(text):
    """Key texts of a read's anchors, by plain loops."""
    mers = [text[i : i + 9] for i in range(len(text) - 8)]
    best = sorted({min(((mers[j], -j) for j in range(i, i + 12))) for i in range(len(mers) - 11)}, key=lambda x: -x[1])
    return Counter((a, b) for i, (a, p) in enumerate(best) for b, q in best[i + 1 :] if 18 < -q + p <= 80 and not a == b == "A" * 9)


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_anchor_batches_are_bounded(spark, monkeypatch, held):
    """The kernel, given one batch of all reads, hands on PAIRS rows at most at once, or one read's."""
    import pyarrow as pa

    monkeypatch.setattr(seeds, "PAIRS", held)
    rows = texts()
    frame = spark.createDataFrame(rows, "cluster_id string, r_id int, seq string")
    taken = {}

    class Reads:
        schema = frame.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            taken["run"] = run

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], ["cluster_id", "r_id", "seq"])
    most = max(len(anchors(t)) for _, _, t in rows if t)
    for by_read in (True, False):
        seeds.anchor_keys(Reads(), 9, 20, 18, 80, by_read=by_read)
        out = list(taken["run"](iter([batch])))
        assert max(x.num_rows for x in out) <= max(held, most)
        want = Counter()
        for c, i, t in rows:
            for _, n in anchors(t).items() if t else ():
                want[(c, i if by_read else None)] += n
        got = Counter()
        for x in out:
            for c, i, n in zip(*(x.column(j).to_pylist() for j in (0, 1, 3)), strict=True):
                got[(c, i)] += n
        assert got == want


def test_anchor_counts_do_not_depend_on_the_bound(spark, monkeypatch):
    monkeypatch.setattr(seeds, "PAIRS", 300)
    rows = [(c, i, t) for c, i, t in texts(30)] + [("x", 100, texts(2)[1][2])]
    occurrences, reads = Counter(), Counter()
    for c, _, t in rows:
        for (a, b), n in anchors(t).items() if t else ():
            occurrences[(c, a, b)] += n
            reads[(c, a, b)] += 1
    got = seeds.anchor_counts(spark.createDataFrame(rows, "cluster_id string, r_id int, seq string"), 9, 20, 18, 80).collect()
    assert {(r.cluster_id, r.m1, r.m2): (r.occurrences, r.reads) for r in got} == {k: (n, reads[k]) for k, n in occurrences.items()}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_support_join_shuffles_anchors_once(spark, sf_dir):
    """One pass of the kernel, whose rows meet their sums in a window instead of a join."""
    from helixframe.catalogue import QUERIES

    assert plan(QUERIES["anchor_support_join"](spark, sf_dir)).count("MapInArrow") == 1


def test_known_introns_reads_line_items_once(spark, sf_dir):
    from helixframe.catalogue.assessment import known_introns

    assert plan(known_introns(spark, sf_dir)).count("Relation") == 1


def test_gaps_parse_a_cigar_once(spark):
    from helixframe.operators import evaluation as E

    rows = spark.createDataFrame([(1, 1, 2, 5, "3=2D4N1="), (2, 1, 2, 5, "3="), (3, 1, 2, 5, None)], "qname long, ord long, rname int, start int, cigar string")
    assert [tuple(r) for r in E.gaps(rows, "N").collect()] == [(1, 1, 2, 10, 14)]
    assert plan(E.gaps(rows, "N")).count("regexp_extract_all") == 1


def test_same_isoform_derives_reads_once(spark):
    from helixframe.operators import assessment as A

    reads = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 2), (1, 0, 5, 6), (2, 0, 1, 2), (3, 1, 1, 2)], "qname long, rname int, start int, stop int")
    known = spark.createDataFrame([(0, 7, 1, 2), (0, 7, 5, 6), (0, 7, 5, 6), (0, 8, 1, 2), (0, 9, 1, 2), (0, 9, 8, 9)], "chrom int, tx long, start int, stop int")
    found = A.same_isoform(reads, known)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, 8)]
    assert plan(found).count("LogicalRDD") == 2


def test_places_are_those_of_the_per_read_table(spark, sf_dir):
    """The narrow table that location_stability reads, without splice details or cluster sizes."""
    from helixframe.catalogue import assessment as C
    from helixframe.operators import assessment as A

    columns = ["acc", "read_type", "chr_id", "reference_start", "reference_end", "error_rate"]
    narrow = A.per_read_places(*C._sides(spark, sf_dir), C.known_introns(spark, sf_dir))
    assert "collect_list" not in plan(narrow)
    whole = C._results(spark, sf_dir).select(*columns)
    assert sorted(map(tuple, narrow.select(*columns).collect())) == sorted(map(tuple, whole.collect()))


def test_window_minimizers_and_spans(spark, monkeypatch):
    """The kernels against the array expressions, in one pass over Arrow batches; other signs, short, empty and null sequences, poly-A."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(seeds, "PAIRS", 50)
    rows = texts(20) + [("z", 100, "ACG"), ("z", 101, ""), ("z", 102, "acgtNNé" * 12), ("z", 103, "A" * 50 + "C" + "A" * 60), ("z", 104, "ACGTU-N" * 9), ("z", 105, "T" * 20)]
    reads = spark.createDataFrame(rows, "cluster_id string, r_id int, seq string")
    array = reads.select("cluster_id", "r_id", seeds.window_minimizer_array(F.col("seq"), 9, 20).alias("m")).cache()
    want = array.select("cluster_id", "r_id", F.explode("m").alias("m")).select("cluster_id", "r_id", (-F.col("m.neg")).alias("pos"), "m.kmer")
    got = seeds.window_minimizers(reads, 9, 20)
    assert "MapInArrow" in plan(got)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    mins = array.select("cluster_id", "r_id", F.transform("m", lambda x: F.struct(x["kmer"].alias("kmer"), (-x["neg"]).alias("pos"))).alias("minimizers"))
    pairs = seeds.exploded_pairs(mins, 18, 80, 9).groupBy("cluster_id", "r_id").agg(F.count("*"), F.min(F.col("p2") - F.col("p1")), F.max(F.col("p2") - F.col("p1")))
    spans = seeds.pair_spans(reads, 9, 20, 18, 80)
    assert sorted((tuple(r) for r in spans.collect()), key=repr) == sorted((tuple(r) for r in pairs.collect()), key=repr)


def test_exact_minimizers_hold_few_reads_as_objects(spark, monkeypatch):
    monkeypatch.setattr(seeds, "READS", 3)
    rows = texts(20) + [("z", 100, "ACG"), ("z", 101, ""), ("z", 102, "acgtNNé" * 12)]
    got = seeds.with_minimizers(spark.createDataFrame(rows, "cluster_id string, r_id int, seq string").coalesce(1), 9, 20).collect()
    assert {r.r_id: [tuple(m) for m in r.minimizers] for r in got} == {i: seeds.minimizers(t, 9, 20) if t is not None else [] for _, i, t in rows}


def test_sequence_files_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    """A cluster's records stand in more than one file, so neither writing nor proving ranges is left to a task for each cluster."""
    from collections import Counter

    from helixframe.catalogue import relations

    seen = []
    read = relations.ranges.read_records
    monkeypatch.setattr(relations.ranges, "read_records", lambda spark, path, **more: seen.append(relations.ranges.list_files(spark, path)) or read(spark, path, **more))
    relations.sequence_ranges(spark, sf_dir).collect()
    assert min(Counter(p.rsplit("/", 2)[1] for p, _ in seen[0]).values()) > 1


@pytest.mark.parametrize("made", ["poa", "multialignment", "correction"])
def test_costly_groups_are_not_drawn_together(spark, made):
    """Few bytes, but long work: one task would have all of them."""
    from helixframe.operators import correction
    from helixframe.operators.udfs import multialign_by, poa_by
    from helixframe.plans.params import Params

    rows = [(i, r, f"a{i}_{r}", "ACGTTGCAGGT" * 3, "+" * 33) for i in range(40) for r in (1, 2)]
    reads = spark.createDataFrame(rows, "cluster_id long, r_id int, acc string, seq string, qual string")
    out = {"poa": lambda: poa_by(reads, "cluster_id"), "multialignment": lambda: multialign_by(reads, "cluster_id"), "correction": lambda: correction.correct(reads, Params(exact=True))}[made]()
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_neighbouring_ranges_share_a_task(spark, tmp_path, monkeypatch):
    """Tasks grow with what is read, not with the number of ranges; none is left out, and none has much more than its share."""
    from helixframe.sources import ranges

    parts = [ranges.Range("a", i, 10 * i, 10 * i + 10, None, 0) for i in range(1000)]
    for tasks, most, want in ((8, 10**6, 8), (8, 100, 100), (5000, 10**6, 1000)):
        made = ranges.packed(parts, tasks, most)
        assert [p for t in made for p in t.parts] == parts and len(made) == want
    assert ranges.packed([], 8, 100) == []
    (tmp_path / "a.fastq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(2000)))
    for read in (ranges.read_records, ranges.read_records4):
        got = read(spark, f"{tmp_path}/a.fastq", 64)
        assert got.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
        assert [tuple(r) for r in got.orderBy("r_id").select("r_id", "acc").collect()] == [(i + 1, f"r{i}") for i in range(2000)]


def test_kmers_are_counted_before_they_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(seeds, "PAIRS", 700)
    r = np.random.default_rng(3)
    rows = [("xyz"[i % 3] if i % 5 else None, "".join("ACGT"[j] for j in r.integers(0, 2, r.integers(0, 300)))) for i in range(60)] + [("x", None), ("x", "A" * 2000), ("y", "ACGTNACGTA")]
    reads = spark.createDataFrame(rows, "cluster_id string, seq string")
    for k in (5, 15, 31):
        every = Counter((c, s[i : i + k]) for c, s in rows if s for i in range(len(s) - k + 1))
        target = {m for _, m in every if set(m) <= set("ACGT") and m < "AC"} | {"T" * k}
        out = seeds.kmer_counts(reads, spark.createDataFrame([(m,) for m in sorted(target)], "kmer string"), k)
        assert {(c, m): n for c, m, n in out.collect()} == {x: n for x, n in every.items() if x[1] in target}
    from helixframe.catalogue.reads import kmer_count_target

    plan = kmer_count_target(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and plan.count("mapInArrow") + plan.count("MapInArrow") > 0


def test_consensus_takes_every_read_of_a_group(spark):
    """Of 201 reads and then 500 of another kind the later ones are the consensus; copies are sent once and count each."""
    from helixframe.operators.alignment import consensus
    from helixframe.operators.udfs import poa_by

    r = np.random.default_rng(1)
    one, two = ("".join("ACGT"[j] for j in r.integers(0, 4, 40)) for _ in range(2))
    noisy = [two[:i] + "ACGT"[j] + two[i + 1 :] for i in range(5, 35) for j in range(4)]
    seqs = {7: [one] * 201 + noisy + [two] * 380, None: [None, "", two], 8: [None]}
    rows = [(k, i, t) for k, texts_ in seqs.items() for i, t in enumerate(texts_)]
    got = {k: (n, c) for k, n, c in poa_by(spark.createDataFrame(rows, "k long, r_id int, seq string"), "k").collect()}
    assert got == {k: (len(t), consensus([x or "" for x in t])) for k, t in seqs.items()}
    assert two in got[7][1] and got[None] == (3, two) and got[8] == (1, "")


def test_anchors_travel_as_differences_of_their_order(spark, monkeypatch):
    """A task hands on a value for a bucket, of few bytes for each anchor; sums don't depend on how many are packed or merged at once."""
    r = np.random.default_rng(2)
    made = ["".join("ACGT"[j] for j in r.integers(0, 4, 900)) for _ in range(40)]
    rows = [("x" if i % 4 else None, i, t) for i, t in enumerate(made * 2)] + [("x", 500 + i, t[:450] + "-" + t[450:]) for i, t in enumerate(made * 2)]
    frame = spark.createDataFrame(rows, "cluster_id string, r_id int, seq string").repartition(2)
    sent = seeds._packed_anchors(frame, 9, 20, 18, 80, False).agg(F.sum("n"), F.sum(F.length("data"))).first()
    assert sent[1] < 6 * sent[0]  # a row of a cluster, a key and two sums takes 40
    monkeypatch.setattr(seeds, "PACKED", 6000)
    monkeypatch.setattr(seeds, "MERGED", 50)
    occurrences, reads = Counter(), Counter()
    for c, _, t in rows:
        for (a, b), n in anchors(t).items():
            occurrences[(c, a, b)] += n
            reads[(c, a, b)] += 1
    got = seeds.anchor_counts(frame, 9, 20, 18, 80, least=2).collect()
    assert {(x.cluster_id, x.m1, x.m2): (x.occurrences, x.reads) for x in got} == {k: (n, reads[k]) for k, n in occurrences.items() if n > 1}
    assert any("-" in x.m1 for x in got)


def test_anchor_support_equals_plain_counts(spark, monkeypatch):
    """Packed anchors with their reads, in small packs, parts and blocks; numbers of reads may be negative."""
    monkeypatch.setattr(seeds, "PACKED", 3000)
    monkeypatch.setattr(seeds, "MERGED", 60)
    monkeypatch.setattr(seeds, "BLOCK", 16)
    r = np.random.default_rng(4)
    made = ["".join("ACGT"[j] for j in r.integers(0, 4, 500)) for _ in range(6)]
    rows = [("xy"[i % 2] if i % 9 else None, 3 * i - 20, made[i % 6][i:] + ("-" if i % 5 == 0 else "") + made[i % 3][: 9 * i]) for i in range(40)]
    rows += [("p", 7, made[0] * 25), ("p", 8, "A" * 60), ("z", 1, None), ("z", 2, "AC")]
    found, sizes = {}, Counter(c for c, _, _ in rows)
    occurrences, reads = Counter(), Counter()
    for c, _, t in rows:
        for (a, b), n in anchors(t).items() if t and len(t) >= 20 else ():
            occurrences[(c, a, b)] += n
            reads[(c, a, b)] += 1
    kept = {x for x, n in occurrences.items() if n >= 3 and not (n > sizes[x[0]] and (x[2] == "A" * 9 or n > 10 * sizes[x[0]]))}
    assert len(kept) < sum(n >= 3 for n in occurrences.values())
    for c, i, t in rows:
        mine = [(n, reads[(c, *x)]) for x, n in anchors(t).items() if (c, *x) in kept] if c and t and len(t) >= 20 else []
        if mine:
            found[(c, i)] = (sum(n for n, _ in mine), max(s for _, s in mine), sum(n * s for n, s in mine))
    frame = spark.createDataFrame(rows, "cluster_id string, r_id int, seq string").repartition(3)
    counts = frame.groupBy("cluster_id").agg(F.count("*").alias("n_reads"))
    assert {(x[0], x[1]): tuple(x[2:]) for x in seeds.anchor_support(frame, counts, 9, 20, 18, 80).collect()} == found


def test_cigars_are_parsed_in_one_pass_of_a_kernel(spark, sf_dir):
    """The kernel against the array expressions, with signs that aren't operations, nulls and slices; no per-read step parses texts in expressions."""
    from helixframe.catalogue import QUERIES
    from helixframe.functions import cigar as C

    r = np.random.default_rng(6)
    texts_ = ["".join(f"{r.integers(0, 300)}{'=XIDMNSHP'[r.integers(0, 9)]}" for _ in range(r.integers(0, 9))) for _ in range(60)] + [None, "", "*", "D", "12", "7=3", "5Q3=4D", "=3D", "3DD4N", "007N1D"]
    rows = [(i, t, None if i % 13 == 5 else 7 * i) for i, t in enumerate(texts_)]
    frame = spark.createDataFrame(rows, "i int, cigar string, start int").repartition(3)
    ops = C.operations(F.col("cigar"))
    total = lambda kinds, below=None: C.total(ops, kinds, below)
    span = F.col("start") + total("=XMDN")
    placed = F.transform(F.filter(C.reference_places(ops, F.col("start")), lambda o: o["op"].isin("N", "D")), lambda o: F.struct((o["op"] == "N").alias("intron"), o["pos"].alias("start"), (o["pos"] + o["n"]).alias("stop")))
    want = frame.select("i", total("I"), total("D"), total("D", 15), total("X"), total("="), span, F.coalesce(placed, F.array()))
    got = frame.withColumn("p", C.parts(F.col("cigar"), F.col("start"), 15)).select("i", "p.ins", "p.del", "p.short", "p.subs", "p.matches", "p.stop", "p.gaps")
    assert {tuple(map(repr, map(plain, x))) for x in got.collect()} == {tuple(map(repr, map(plain, x))) for x in want.collect()}
    for name in ("per_read_genome", "location_stability", "known_deletions"):
        assert "regexp_extract_all" not in plan(QUERIES[name](spark, sf_dir))


def plain(value):
    return [tuple(x) for x in value] if isinstance(value, list) else value
