"""Byte ranges, committed cluster files, and steps of the correction as relations, against whole-file and whole-batch forms."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.operators import columns, evaluation, nearest, relations, seeds
from helixframe.operators.correction import Batch, Runs, candidates, error_sums
from helixframe.operators.matrix import alternatives, context_windows, corrected_rows, frequent_contexts
from helixframe.plans.params import Params
from helixframe.sources import cluster_files, ranges
from helixframe.sources import sequence_files as S
from tests.test_kernels import noisy_cluster


def wrapped(text, n):
    return "\n".join(text[i : i + n] for i in range(0, len(text), n)) if text else ""


def sequence_file(r, records, kind):
    out = ["; a preamble without a header\n"] if r.random() < 0.5 else []
    for i in range(records):
        n = r.choice([0, 1, 5, 60, 400])
        seq = "".join(r.choice("ACGT") for _ in range(n))
        qual = "".join(r.choice("@>+!I") for _ in range(n))  # looks like headers and separators
        end = r.choice(["\n", "\r\n"])
        width = r.choice([7, 60, 1000])
        if kind == "fasta" or kind == "mixed" and r.random() < 0.3:
            out.append(f">seq {i} x\n{wrapped(seq, width)}\n".replace("\n", end))
        else:
            out.append(f"@read {i} x\n{wrapped(seq, width)}\n+\n{wrapped(qual, r.choice([7, 60]))}\n".replace("\n", end))
    text = "".join(out)
    return text if r.random() < 0.5 else text[: len(text) - r.randint(0, 80)]


@pytest.mark.parametrize("kind", ["fasta", "fastq", "mixed"])
def test_ranges_equal_the_whole_file(spark, tmp_path, kind):
    r = random.Random(kind)
    expected = []
    for n in range(5):
        text = sequence_file(r, r.choice([0, 1, 60]), kind)
        (tmp_path / f"{n}.fq").write_bytes(text.encode())
        expected += [(f"{n}.fq", i, *x) for i, x in enumerate(S.parse(text.split("\n")), 1)]
    for size in (97, 1000, 1 << 20):
        got = ranges.read_records(spark, f"{tmp_path}/*.fq", size).collect()
        assert sorted((os.path.basename(x.path), x.r_id, x.acc, x.seq, x.qual) for x in got) == sorted(expected, key=lambda x: x[:2])


def test_guesses_are_proven_not_trusted(spark, tmp_path):
    """Qualities that hold whole records: every range that begins among them guesses wrong and is asked again."""
    inner = "@fake\nACGT\n+\nIIII\n"
    lines = inner.strip().split("\n") * 30
    qual = "\n".join(lines)
    size = sum(map(len, lines))
    text = f"@real\n{'A' * size}\n+\n{qual}\n@next\nAC\n+\nII\n"
    (tmp_path / "a.fastq").write_text(text)
    got = ranges.read_records(spark, f"{tmp_path}/a.fastq", 64).orderBy("r_id").collect()
    assert [tuple(x)[1:] for x in got] == [(1, "real", "A" * size, "".join(lines)), (2, "next", "AC", "II")]
    with ranges._File(f"{tmp_path}/a.fastq") as file:
        assert any(ranges.guess(file, lo, lo + 64) not in (None, 0, text.index("@next")) for lo in range(size + 64, len(text), 64))


def test_no_task_reads_far(tmp_path):
    """A range reads its own bytes, the record that its end cuts, and a look ahead."""
    text = "".join(f"@r{i}\n{'ACGT' * 50}\n+\n{'I' * 200}\n" for i in range(20_000))
    (tmp_path / "a.fastq").write_text(text)
    part = ranges.Range(f"{tmp_path}/a.fastq", 3, 3 << 20, (3 << 20) + 100_000, None, 0)
    seen = []
    original = ranges._File.__init__

    def counting(self, path):
        original(self, path)
        read = self.read
        self.read = lambda n: seen.append(n) or read(n)

    ranges._File.__init__ = counting
    try:
        row = ranges.answer(part)
    finally:
        ranges._File.__init__ = original
    assert sum(seen) <= 4 * ranges.CHUNK and row[6] == sum(part.lo <= m.start() < part.hi for m in re.finditer("@r", text))


def test_four_line_records(spark, tmp_path):
    r = random.Random(4)
    for n, tail in enumerate(["", "@cut\nACG\n+\n", "@cut\nACG", "@empty\n\n+\n", "\n\n"]):
        body = "".join(f"@r {i}\n{'A' * (k := r.randint(1, 30))}\n+\n{'@' * k}\n" for i in range(40))
        (tmp_path / f"{n}.fq").write_text(body + tail)
        lines = (body + tail).split("\n")
        expected = [(i + 1, lines[4 * i][1:].replace(" ", "_"), lines[4 * i + 1], lines[4 * i + 3]) for i in range(len(lines) // 4)]
        for size in (50, 1 << 20):
            got = ranges.read_records4(spark, f"{tmp_path}/{n}.fq", size).orderBy("r_id").collect()
            assert [tuple(x)[1:] for x in got] == expected
    assert ranges.read_records4(spark, f"{tmp_path}/none*.fq").count() == 0 and ranges.read_records(spark, f"{tmp_path}/none*.fq").count() == 0


# Cluster files


def reads_frame(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, r_id int, acc string, seq string, qual string")


def test_a_large_cluster_is_written_by_many_tasks(spark, tmp_path):
    rows = [(7 if i % 3 else i % 5, i + 1, f"r{i}", "ACGT" * (i % 9), "IIII" * (i % 9)) for i in range(900)] + [(None, 1, None, None, None)]
    written = cluster_files.write_clusters(reads_frame(spark, rows), f"{tmp_path}/out", tasks=8).collect()
    assert {w.cluster: w.records for w in written} == {"7": 600, **{str(c): sum(i % 3 == 0 and i % 5 == c for i in range(900)) for c in range(5)}, "null": 1}
    assert max(w.pieces for w in written if w.cluster == "7") > 1
    back = ranges.read_records4(spark, f"{tmp_path}/out/7/{cluster_files.FILE}", 2000).orderBy("r_id").collect()
    assert [(x.acc, x.seq) for x in back] == [(a, s) for c, _, a, s, _ in rows if c == 7]
    assert sorted(os.listdir(f"{tmp_path}/out")) == sorted([str(c) for c in range(5)] + ["7", "null"])
    assert os.listdir(f"{tmp_path}/out/7") == [cluster_files.FILE]


def test_batches_by_name_and_restart(spark, tmp_path):
    rows = [(1, i, f"a{i}", "A", "I") for i in range(1, 31)] + [(2, i, f"b{i}", "C", "I") for i in range(1, 5)]
    cluster_files.write_clusters(reads_frame(spark, rows), f"{tmp_path}/o", by_name=2)
    names = [x.acc for x in ranges.read_records4(spark, f"{tmp_path}/o/1/{cluster_files.FILE}").orderBy("r_id").collect()]
    assert names == [f"a{i}" for i in sorted(range(1, 31), key=lambda i: (str((i - 1) // 2), i))]
    more = [*rows, (2, 5, "b5", "C", "I"), (3, 1, "c1", "G", "I")]
    done = cluster_files.write_clusters(reads_frame(spark, more), f"{tmp_path}/o", replace=False).collect()
    assert {(w.cluster, w.records) for w in done} == {("2", 5), ("3", 1)}
    assert {(x.cluster, x.records) for x in cluster_files.finished(spark, f"{tmp_path}/o").collect()} == {("1", 30), ("2", 5), ("3", 1)}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = reads_frame(spark, [(1, 1, "a", "AC", "II"), (2, 1, "b", "GT", "II")])
    cluster_files.write_clusters(rows, f"{tmp_path}/o")
    before = open(f"{tmp_path}/o/1/{cluster_files.FILE}").read()
    broken = rows.withColumn("seq", F.when(F.col("cluster_id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.lit("TTTT")))
    with pytest.raises(Exception, match="broken"):
        cluster_files.write_clusters(broken, f"{tmp_path}/o", tasks=2)
    assert sorted(os.listdir(f"{tmp_path}/o")) == ["1", "2"] and open(f"{tmp_path}/o/1/{cluster_files.FILE}").read() == before


def test_pieces_of_other_attempts_are_not_taken_up(tmp_path):
    import pyarrow as pa

    writer = cluster_files.ClusterWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"cluster": ["x", "x"], "batch": ["", ""], "r_id": [1, 2], "record": ["a\n", "b\n"]})
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([second, None])
    listed = (tmp_path / "pieces").read_text()
    assert second.pieces[0][3] in listed and first.pieces[0][3] not in listed
    writer.abort([])
    assert os.listdir(tmp_path) == []


# Open anchors and support


def cluster(r, n=14):
    seqs = noisy_cluster(reads=n)[1]
    return [(i + 1, s, "".join(chr(33 + r.randint(5, 30)) for _ in s)) for i, s in enumerate(seqs)]


def made_spans(r, length):
    return [(a := r.randint(0, max(1, length - 30)), a + r.randint(-2, 60)) for _ in range(r.choice([0, 1, 4]))]


@pytest.mark.parametrize("seed", range(3))
def test_open_anchors_and_support_equal_the_batch(spark, seed):
    r, p = random.Random(seed), Params(k=7, w=11, xmin=14, xmax=50)
    reads = cluster(r)
    batch = Batch({i: s for i, s, _ in reads}, {i: error_sums(q) for i, _, q in reads}, p)
    spans = {i: made_spans(r, len(s)) for i, s, _ in reads}
    rows = [("c", i, s, q) for i, s, q in reads]
    df = spark.createDataFrame(rows, "cluster_id string, r_id int, seq string, qual string")
    pairs = seeds.exploded_pairs(seeds.with_minimizers(df, p.k, p.w), p.low, p.xmax, p.k).cache()
    done = spark.createDataFrame([("c", i, a, b) for i, xs in spans.items() for a, b in xs], "cluster_id string, r_id int, start int, stop int")
    opened = relations.open_anchors(pairs, done, p.k)
    runs = {i: Runs(xs) for i, xs in spans.items()}
    expected = set()
    for x in pairs.collect():
        a, b = runs[x.r_id].at(x.p1 + p.k), runs[x.r_id].at(x.p2 - 1)
        if a is None or b is None or a != b:
            expected.add((x.r_id, x.p1, x.p2, int(a is not None and b is not None)))
    assert {(x.r_id, x.p1, x.p2, x.across) for x in opened.collect()} == expected
    assert not any(spans.values()) or len(expected) < pairs.count()
    counts = pairs.groupBy("cluster_id", "m1", "m2").agg(F.count("*").alias("occurrences"))
    kept = seeds.kept_anchors(counts, df.groupBy("cluster_id").agg(F.count("*").alias("n_reads")), p.k)
    got = {}
    for x in relations.support_exact(df, pairs, kept, opened, p.k).orderBy("r_id", "p1", "p2", "rank").collect():
        got.setdefault((x.r_id, x.p1 + p.k, x.p2, x.weight), []).append((x.other, x.q1, x.q2))
    plain = {(i, *c[:3]): c[3] for i, xs in spans.items() for c in candidates(batch, i, [(a, b, 2, "") for a, b in xs])}
    assert got == plain and len(got) > 20


def rule(rows, ref="ACGTACGTAC", own=None, error=1.0):
    """Segments that the table function chooses for anchors (p1, p2, places) of read 1; places: (other, q1, q2, text)."""
    table = relations.SupportOf.func()
    out = []
    for p1, p2, places in rows:
        made = [dict(zip(("other", "q1", "q2", "text", "error"), (*x, error), strict=True)) for x in places]
        out.append([x[6:] for x in table.eval({"cluster_id": "c", "r_id": 1, "p1": p1, "p2": p2, "ref": ref, "error": error, "places": made})])
    return out


def test_rules_of_support():
    ref = "ACGTACGTAC"
    # An equal text replaces what was chosen, and comes with distance 0.
    assert rule([(0, 9, [(2, 0, 9, "ACGTACGTAA"), (2, 30, 39, ref)])]) == [[(1, 0, 9, 0.0), (2, 30, 39, 0.0)]]
    # Of two segments the closer one stays; the second is aligned even where its text is known.
    assert rule([(0, 9, [(2, 0, 9, "ACGTACGTAA"), (2, 30, 39, "ACGTACGGAA")])]) == [[(1, 0, 9, 0.0), (2, 0, 9, 1.0)]]
    # A known text has the distance it had.
    assert rule([(0, 9, [(2, 0, 9, "ACGTACGTAA"), (3, 5, 14, "ACGTACGTAA")])])[0][2] == (3, 5, 14, 1.0)
    # Beyond the length of the read's own text there is no segment.
    assert rule([(0, 9, [(2, 0, 30, "T" * 31)])]) == [[(1, 0, 9, 0.0)]]
    # An enclosed span is estimated from the measured one, not aligned, within the expected errors; beyond them it is aligned.
    first = (0, 20, [(2, 0, 20, "ACGTACGTAA")])
    inner = (2, 15, [(2, 3, 15, "TTTTTTTTTT")])
    assert rule([first, inner])[1][1] == (2, 3, 15, 1.0 + 1)
    assert rule([first, inner], error=0.01)[1][1] == (2, 3, 15, 8.0)
    # An estimate isn't remembered as measured: the next one starts from the measured span again.
    assert rule([first, inner, (3, 14, [(2, 5, 14, "TTTTTTTTTT")])])[2][1] == (2, 5, 14, 1.0 + 2)


def test_open_anchors_of_nulls_and_no_spans(spark):
    pairs = spark.createDataFrame([(None, 1, 0, 30, "a"), ("c", 2, 0, 30, "b")], "cluster_id string, r_id int, p1 int, p2 int, m1 string")
    none = spark.createDataFrame([], "cluster_id string, r_id int, start int, stop int")
    assert sorted(x.m1 for x in relations.open_anchors(pairs, none, 9).collect()) == ["a", "b"]
    spans = spark.createDataFrame([(None, 1, 5, 40), ("c", 2, 5, 12), ("c", 2, 25, 40), ("c", 2, 40, 41), ("c", 2, 9, 9)], "cluster_id string, r_id int, start int, stop int")
    assert [(x.m1, x.across) for x in relations.open_anchors(pairs, spans, 9).collect()] == [("b", 1)]
    assert sorted((x.r_id, x.start, x.stop) for x in relations.runs_of(spans, ("cluster_id", "r_id")).collect()) == [(1, 5, 40), (2, 5, 12), (2, 25, 41)]


# Nearest references


def noisy(r, text, rate):
    out = []
    for ch in text:
        x = r.random()
        if x < rate:
            out.append(r.choice(["", r.choice("ACGT"), ch + r.choice("ACGT")]))
        else:
            out.append(ch)
    return "".join(out)


def test_nearest_equals_all_pairs(spark, monkeypatch):
    from helixframe.operators.alignment import edit_distance

    r = random.Random(3)
    short = ["".join(r.choice("AC") for _ in range(r.randint(0, 7))) for _ in range(60)]
    refs = [(i, t) for i, t in enumerate(["", "A", "ACA", "CCCCCC", "ACA", "".join(r.choice("ACGT") for _ in range(80))])] + [(9, None)]
    reads = [(i, t) for i, t in enumerate([*short, noisy(r, refs[5][1], 0.2), "G" * 30])] + [(99, None)]
    a, b = spark.createDataFrame(reads, "k int, s string"), spark.createDataFrame(refs, "ref int, rs string")
    for most, small in ((4, 0), (1000, 0), (4, 10**6), (1000, 10**6)):
        monkeypatch.setattr(nearest, "SMALL", small)
        far = {i: sorted((edit_distance(t, x), j) for j, x in refs if x is not None and edit_distance(t, x) < most) for i, t in reads if t is not None}
        tied = {(i, j, d) for i, xs in far.items() for d, j in xs if d == xs[0][0]}
        assert {tuple(x) for x in evaluation.nearest(a, b, "k", "ref", "s", "rs", most=most, ties=True).collect()} == tied
        assert {tuple(x) for x in evaluation.nearest(a, b, "k", "ref", "s", "rs", most=most).collect()} == {(i, xs[0][1], xs[0][0]) for i, xs in far.items() if xs}


def test_few_pairs_are_compared(spark, monkeypatch):
    """Reads of a tenth of errors meet few references, and no plan joins without keys."""
    r = random.Random(6)
    refs = [(i, "".join(r.choice("ACGT") for _ in range(r.randint(380, 420)))) for i in range(60)]
    reads = [(i, noisy(r, refs[i % 60][1], 0.05)) for i in range(240)]
    texts, few = spark.createDataFrame(reads, "tid int, t string"), spark.createDataFrame(refs, "rid int, rt string")
    compared = 0
    left = texts
    for e in (0, 1, 3, 7, 15, 31, 63):
        met = nearest.within(left, few, e)
        assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
        pairs = met.collect()
        compared += len(pairs)
        done = {x.tid for x in met.join(left, "tid").join(few, "rid").filter(F.levenshtein("t", "rt", e) >= 0).collect()}
        left = spark.createDataFrame([x for x in left.collect() if x.tid not in done], "tid int, t string")
        if left.isEmpty():
            break
    assert left.isEmpty() and compared < 240 * 60 / 10
    monkeypatch.setattr(nearest, "SMALL", 0)
    found = nearest.nearest_pairs(texts, few, 1000, lambda t, rt, e: F.levenshtein(t, rt, e)).collect()
    assert {(x.tid, x.rid) for x in found} == {(i, i % 60) for i in range(240)}


def test_best_infix_equals_all_pairs(spark):
    from helixframe.operators.alignment import infix_distance
    from helixframe.operators.assessment import truth_errors

    r = random.Random(7)
    refs = [(f"r{9 - i}", "".join(r.choice("ACGT") for _ in range(120))) for i in range(8)]
    forms = [noisy(r, refs[i % 8][1][10:70], 0.15) for i in range(30)] + ["N", "NNNN", "A", "AN", "", None]
    df = spark.createDataFrame([(i, t, "ACG") for i, t in enumerate(forms)], "k int, t string, u string")
    got = {x.k: (x.truth, x.t_ed, x.u_ed) for x in truth_errors(df, spark.createDataFrame(refs, "name string, seq string"), "k", "t", ["t", "u"], "name", "seq").collect()}
    best = {i: min((infix_distance(t, s), n, s) for n, s in refs) for i, t in enumerate(forms) if t}
    assert got == {i: (n, d, infix_distance("ACG", s)) for i, (d, n, s) in best.items()}


# Column rules


def alignment(r, readers, width):
    """Rows of one length with a few frequent variants, gaps among them, and noise."""
    center = [r.choice("ACGT") if r.random() < 0.9 else "-" for _ in range(width)]
    kinds = []
    for _ in range(3):
        kind = list(center)
        for _ in range(r.randint(1, 4)):
            kind[r.randrange(width)] = r.choice("ACGT-")
        kinds.append(kind)
    rows = []
    for _ in range(readers):
        row = list(r.choice([center, *kinds]))
        if r.random() < 0.3:
            row[r.randrange(width)] = r.choice("ACGT-")
        rows.append("".join(row))
    return "".join(center), rows


def test_column_rules_equal_the_batch(spark):
    k, ratio, made, expected, beside = 9, 0.1, [], set(), set()
    for item in range(12):
        r = random.Random(item)
        center, rows = alignment(r, r.choice([4, 30, 70]), 60)
        made += [(item, i, row, center, i, i + len(row.replace("-", "")) - k) for i, row in enumerate(rows)]
        expected |= {(item, i, text) for i, text in corrected_rows(dict(enumerate(rows)), center, k, ratio).items()}
        windows, threshold = context_windows(center, k // 2), max(3, len(rows) * ratio)
        found = alternatives(center, frequent_contexts([*rows, center], windows, threshold), windows, threshold)
        beside |= {(item, col, n, *x) for col, xs in enumerate(found) for n, x in enumerate(xs)}
    df = spark.createDataFrame(made, "item_id int, r_id int, row string, consensus string, q1 int, q2 int").cache()
    assert {tuple(x) for x in columns.corrected(df, k, ratio).collect()} == expected
    wins, limits, centers = columns.windows(df.select("item_id", "consensus").distinct(), k), columns.thresholds(df, ratio), df.select("item_id", "consensus").distinct()
    got = columns.alternatives(columns.contexts(df, wins, limits), centers, wins, limits).select("item_id", "col", F.posexplode("alternatives").alias("n", "x")).select("item_id", "col", "n", "x.*")
    assert {tuple(x) for x in got.collect()} == beside and len({x[:2] for x in beside}) > 20 and any(x[2] for x in beside)
    spans = {(x.item_id, x.r_id): x for x in columns.corrected_spans(df, k, ratio).collect()}
    for item, i, text in expected:
        x = spans[item, i]
        assert (x.start, x.text, x.weight) == (i + k, text[k:-k], sum(e[0] == item for e in expected))


# Chains, growing clusters, published tables


def test_anchor_chains_compare_anchors(spark):
    chains = {1: ["ab", "cd"], 2: ["ab", "cd"], 3: ["cd", "ab"], 4: ["ab"], 5: ["ab", "cd", "cd"], 6: ["ab"]}
    rows = [("c", r, 10 * i, x[0], x[1]) for r, xs in chains.items() for i, x in enumerate(xs)] + [("d", 9, 0, "a", "b"), (None, 8, 0, "a", "b")]
    got = relations.anchor_chains(spark.createDataFrame(rows, "cluster_id string, r_id int, place int, m1 string, m2 string")).collect()
    assert sorted((x.r_id, x.anchors, x.first, x.reads) for x in got if x.cluster_id) == [(1, 2, 1, 2), (2, 2, 1, 2), (3, 2, 3, 1), (4, 1, 4, 2), (5, 3, 5, 1), (6, 1, 4, 2), (9, 1, 9, 1)]
    assert len({x.signature for x in got if x.cluster_id == "c"}) == 4


def test_growing_clusters_equal_one_shot(spark, tmp_path):
    """Reads that come in any order over files and triggers, and a restart between them."""
    import time

    from helixframe.operators.correction import correct
    from helixframe.streaming import correct_growing

    schema = "cluster_id string, r_id int, acc string, seq string, qual string"
    reads = noisy_cluster(reads=13)[1]
    rows = [(c, i + 1, f"{c}{i}", s, "5" * len(s)) for c in ("x", "y") for i, s in enumerate(reads)] + [("z", 1, "z0", None, None)]
    params = Params(batch_size=5)
    expected = sorted(map(repr, map(tuple, correct(spark.createDataFrame(rows, schema), params).collect())))
    shuffled = random.Random(3).sample(rows, len(rows))
    (tmp_path / "in").mkdir()

    def arrive(n, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/made{n}")
        for name in os.listdir(f"{tmp_path}/made{n}"):
            if name.endswith(".parquet"):
                os.rename(f"{tmp_path}/made{n}/{name}", f"{tmp_path}/in/{n}.parquet")

    def start():
        stream = correct_growing(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), params, wait="4 seconds")
        return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()

    def until(done):
        """Runs the stream until done(query), a minute at most: with timeouts it is never out of work."""
        query, end = start(), time.time() + 60
        try:
            while not done(query) and time.time() < end:
                time.sleep(0.5)
        finally:
            query.stop()

    arrive(0, shuffled[:9])
    arrive(1, shuffled[9:14] + shuffled[:2])
    until(lambda query: sum(p.numInputRows for p in query.recentProgress) >= 16)
    arrive(2, shuffled[14:])
    made = lambda: spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()
    until(lambda query: len(made()) >= len(rows))
    got = made()
    assert sorted(map(repr, map(tuple, got))) == expected
    with pytest.raises(ValueError, match="exact_limit"):
        correct_growing(spark.createDataFrame(rows, schema), Params(exact_limit=5))


def test_published_tables_can_be_written(spark, tmp_path):
    from helixframe.operators import published

    true = spark.createDataFrame([("t1", "ACGTACGT")], "transcript string, seq string")
    reads = spark.createDataFrame([("f|g|t1_0", "ACGTACG"), ("f|g|t1_1", "ACGTTCGT"), ("f|h|t9_0", "A")], "acc string, seq string")
    profile = published.error_profile(reads.filter("acc <> 'f|g|t1_1'"), reads, true)
    assert sorted(map(tuple, profile.collect())) == [("f|g|t1_0", 8, 1, 0, 1, 0, 7, 12.5, x, 2, 2, 3) for x in ("corrected", "original")]
    made = spark.createDataFrame([(1, "snp", 10, 0.5, "f|minor|t1_0", "ACGT"), (1, "snp", 10, 0.5, "f|minor|t1_1", "ACGA"), (2, "snp", 20, 0.5, "f|minor|t1_0", "GGGG")], "id int, type string, Depth int, p double, acc string, seq string")
    refs = spark.createDataFrame([("t1", "ACGT"), ("t2", "ACGG"), ("t3", "GGGGG")], "ref_acc string, seq string")
    table = published.perturbation(made, refs)
    assert sorted(map(tuple, table.collect())) == [
        (1, "snp", 10, 0.5, "f|minor|t1_0", "t1", 0, 0.0, 2, 1, 1), (1, "snp", 10, 0.5, "f|minor|t1_1", "t1", 1, 25.0, 2, 1, 1), (2, "snp", 20, 0.5, "f|minor|t1_0", "t3", 1, 20.0, 1, 0, 1)]
    places = published.location_stability(*[spark.createDataFrame(x, "acc string, chr_id string") for x in ([("a,3,4", "1:2"), ("b,5,8", "1"), ("c,1,1", "1")], [("a,3,4", "2:9"), ("b,5,8", "2")])])
    depth = published.aligned_coverage(spark.createDataFrame([("a", "t", 0, 10), ("a", "t", 16, 60), ("b", "t", 0, 9), ("c", "t", 256, 60)], "qname string, rname string, flag int, mapq int"))
    assert sorted(map(tuple, places.collect())) == [(3, 4, 0), (5, 8, 1)] and sorted(map(tuple, depth.collect())) == [("t", "ambiguous", 1), ("t", "unambiguous", 1)]
    for kind, df in (("error_profile", profile), ("perturbation", table), ("location_stability", places), ("aligned_coverage", depth)):
        S.write_results(df, f"{tmp_path}/{kind}", kind)
        assert ",".join(spark.read.option("header", True).csv(f"{tmp_path}/{kind}").columns) == S.RESULTS[kind] == ",".join(df.columns)
