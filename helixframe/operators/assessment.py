"""Per-read evaluation of corrected reads: the tables that published comparisons are made of.

Built-in expressions, but for alignment paths and infix distances, which are Arrow-batched kernels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import operations, parts
from ..functions.sequences import reverse_complement
from . import evaluation as E
from .nearest import nearest_pairs, numbered

PER_READ = [
    "acc", "read_type", "ins", "del", "subs", "matches", "error_rate", "read_length", "aligned_length", "cluster_size", "is_unaligned_in_other_method", "tot_splices", "read_sm_junctions",
    "read_nic_junctions", "fsm", "nic", "ism", "nnc", "no_splices", "donor_acceptors", "donor_acceptors_choords", "transcript_fsm_id", "chr_id", "reference_start", "reference_end", "sam_flag",
]


def error_percent() -> Column:
    wrong = F.col("ins") + F.col("del") + F.col("subs")
    return F.round(100 * wrong / (wrong + F.col("matches")), 4)


def reference_end(cigar: Column, start: Column) -> Column:
    return start + F.aggregate(F.filter(operations(cigar), lambda o: o["op"].isin(*"=XMDN")), F.lit(0), lambda acc, o: acc + o["n"])


def with_parts(alignments: DataFrame, min_intron: int) -> DataFrame:
    """alignments with ins, del, short, subs, matches, stop and gaps of their CIGARs, which are left out."""
    return alignments.withColumn("__parts", parts(F.col("cigar"), F.col("start"), min_intron)).select(*[c for c in alignments.columns if c != "cigar"], "__parts.*")


def with_known_deletions(alignments: DataFrame, annotated: DataFrame, *more: str) -> DataFrame:
    """alignments (with parts) whose `del` leaves annotated introns out; on a reference without annotation, it counts short deletions only.

    An alignment goes by qname, ord and what else more columns tell apart. What is found goes back to them by qname alone, so that
    alignments dealt by qname stay where they are.
    """
    one = [*more, "ord"]
    introns = annotated.select(F.col("chrom").alias("rname"), "start", "stop").distinct()
    # One row for each length of an intron on a reference: a deletion of another length isn't sent to be looked up.
    lengths = F.broadcast(annotated.select(F.col("chrom").alias("rname"), (F.col("stop") - F.col("start")).alias("n")).distinct())
    deleted = alignments.select("qname", *one, "rname", F.explode_outer(F.filter("gaps", lambda g: ~g["intron"])).alias("g")).filter("g is not null").select("qname", *one, "rname", "g.start", "g.stop")
    deleted = deleted.withColumn("n", F.col("stop") - F.col("start")).join(lengths, ["rname", "n"], "left_semi")
    found = deleted.join(introns, ["rname", "start", "stop"], "left_semi").groupBy("qname").agg(F.collect_set(F.struct(*one, "start", "n")).alias("__known"))
    # One row for each reference.
    chroms = F.broadcast(annotated.select(F.col("chrom").alias("rname"), F.lit(True).alias("__chrom")).distinct())
    own = F.filter("__known", lambda x: F.forall(F.array(*[x[c] == F.col(c) for c in one]), lambda same: same))
    known = F.aggregate(own, F.lit(0), lambda acc, x: acc + x["n"])
    rows = alignments.join(found, "qname", "left").join(chroms, "rname", "left")
    return rows.withColumn("del", F.when(F.col("__chrom"), F.coalesce(F.col("del") - F.coalesce(known, F.lit(0)), F.lit(0))).otherwise(F.col("short"))).drop("__known", "__chrom", "short")


def junctions_of(alignments: DataFrame, annotated: DataFrame) -> DataFrame:
    """qname, corr, rname, flag, start, stop of introns, and of deletions that are annotated introns, from the gaps of alignments (with parts)."""
    rows = alignments.select("qname", "corr", "rname", "flag", F.explode_outer("gaps").alias("g")).filter("g is not null").select("qname", "corr", "rname", "flag", "g.intron", "g.start", "g.stop")
    pairs = annotated.select(F.col("chrom").alias("rname"), "start", "stop", F.lit(True).alias("__pair")).distinct()
    return rows.join(pairs, ["rname", "start", "stop"], "left").filter(F.col("intron") | F.col("__pair")).select("qname", "corr", "rname", "flag", "start", "stop", F.coalesce("__pair", F.lit(False)).alias("pair"))


def dinucleotides(junctions: DataFrame, genome: DataFrame) -> DataFrame:
    """junctions with donor and acceptor: the two bases at either end of the intron, from the other strand where flag isn't 0.

    genome: rname, seq. A reference shorter than its coordinates is read round and round.
    """
    seq = genome.select("rname", F.concat("seq", "seq").alias("__seq"), F.length("seq").alias("__n"))
    two = lambda at: F.substring(F.col("__seq"), (F.pmod(at, F.col("__n")) + 1).cast("int"), F.lit(2))
    left, right, plus = two(F.col("start")), two(F.col("stop") - 2), F.col("flag") == 0
    rows = junctions.join(seq, "rname", "left")
    return rows.withColumn("donor", F.when(plus, left).otherwise(reverse_complement(right))).withColumn("acceptor", F.when(plus, right).otherwise(reverse_complement(left))).drop("__seq", "__n")


def splice_details(junctions: DataFrame, annotated: DataFrame) -> DataFrame:
    """qname, corr, tot_splices, read_sm_junctions, read_nic_junctions, donor_acceptors, donor_acceptors_choords, transcript_fsm_id of reads with junctions."""
    site = annotated.select(F.col("chrom").alias("rname"), F.explode(F.array("start", "stop")).alias("at")).distinct()
    seen = junctions
    for side in ("start", "stop"):
        seen = seen.join(site.select("rname", F.col("at").alias(side), F.lit(1).alias(f"{side}_known")), ["rname", side], "left")
    listed = lambda text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "stop", text.alias("t")))), lambda x: x["t"]), ":")
    by_read = seen.groupBy("qname", "corr", "rname").agg(
        F.count("*").alias("tot_splices"), F.count_if("pair").alias("read_sm_junctions"), F.count_if(~F.col("pair") & F.col("start_known").isNotNull() & F.col("stop_known").isNotNull()).alias("read_nic_junctions"),
        listed(F.concat("donor", F.lit("-"), "acceptor")).alias("donor_acceptors"), listed(F.concat_ws("-", "start", "stop")).alias("donor_acceptors_choords"), E.chain("start", "stop").alias("chain"),
    )
    chains = annotated.groupBy("chrom", "tx").agg(E.chain("start", "stop").alias("chain")).groupBy(F.col("chrom").alias("rname"), "chain").agg(F.max("tx").cast("string").alias("transcript_fsm_id"))
    return by_read.join(chains, ["rname", "chain"], "left").drop("chain", "rname")


def per_read_genome(original: DataFrame, corrected: DataFrame, reads: DataFrame, corrected_reads: DataFrame, clusters: DataFrame, annotated: DataFrame, genome: DataFrame, min_intron: int = 15) -> DataFrame:
    """The 26 columns of the per-read table, for original and corrected reads.

    original, corrected: alignments (qname, ord, rname, start, cigar, flag); reads, corrected_reads: qname, read_length;
    clusters: qname, cluster_size (1 where it is missing); annotated: chrom, tx, start, stop of introns; genome: rname, seq.
    A read that the correction doesn't give counts with its original values; reference_end is two beyond the last
    base's end, as in the published tables. Both kinds go through one plan, told apart by the column corr.
    """
    return per_read_table(_both_kinds(original, corrected, annotated, min_intron), reads, corrected_reads, clusters, annotated, genome)


def per_read_table(both: DataFrame, reads: DataFrame, corrected_reads: DataFrame, clusters: DataFrame, annotated: DataFrame, genome: DataFrame) -> DataFrame:
    """per_read_genome of both kinds of alignments as one table, with parts, known deletions and corr. What is keyed by the read alone comes first, where its rows are."""
    best = E.primary(both, "corr")
    details = splice_details(dinucleotides(junctions_of(best, annotated), genome), annotated).withColumnRenamed("qname", "acc")
    rows = best.select(
        F.col("qname").alias("acc"), "corr", "ins", "del", "subs", "matches", error_percent().alias("error_rate"), (F.col("ins") + F.col("del") + F.col("subs") + F.col("matches")).alias("aligned_length"),
        F.col("rname").alias("chr_id"), F.col("start").alias("reference_start"), (F.col("stop") + 2).alias("reference_end"), F.col("flag").alias("sam_flag"),
    )
    sizes = clusters.select(F.col("qname").alias("acc"), "cluster_size")
    rows = _lengths(rows, reads, corrected_reads).join(sizes, "acc", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1)).cast("long"))
    rows = rows.join(details, ["acc", "corr"], "left").fillna(0, ["tot_splices", "read_sm_junctions", "read_nic_junctions"]).fillna("NA", ["donor_acceptors", "donor_acceptors_choords", "transcript_fsm_id"])
    none, fsm = F.col("tot_splices") == 0, F.col("transcript_fsm_id") != "NA"
    known = F.col("tot_splices") == F.col("read_sm_junctions") + F.col("read_nic_junctions")
    flags = {"fsm": ~none & fsm, "nic": ~none & ~fsm & known & (F.col("read_nic_junctions") > 0), "ism": ~none & ~fsm & known & (F.col("read_nic_junctions") == 0), "nnc": ~none & ~fsm & ~known, "no_splices": none}
    return _by_type(rows.withColumns({c: x.cast("int") for c, x in flags.items()})).select(*PER_READ)


def per_read_places(original: DataFrame, corrected: DataFrame, reads: DataFrame, corrected_reads: DataFrame, annotated: DataFrame, min_intron: int = 15) -> DataFrame:
    """acc, read_type, chr_id, reference_start, reference_end, error_rate of per_read_genome: neither junctions nor cluster sizes are looked up for them."""
    return places_table(_both_kinds(original, corrected, annotated, min_intron), reads, corrected_reads)


def places_table(both: DataFrame, reads: DataFrame, corrected_reads: DataFrame) -> DataFrame:
    """per_read_places of both kinds of alignments as one table, with parts, known deletions and corr."""
    best = E.primary(both.drop("gaps"), "corr")
    rows = best.select(F.col("qname").alias("acc"), "corr", error_percent().alias("error_rate"), F.col("rname").alias("chr_id"), F.col("start").alias("reference_start"), (F.col("stop") + 2).alias("reference_end"))
    return _by_type(_lengths(rows, reads, corrected_reads)).select("acc", "read_type", "chr_id", "reference_start", "reference_end", "error_rate")


def _both_kinds(original: DataFrame, corrected: DataFrame, annotated: DataFrame, min_intron: int) -> DataFrame:
    """Both kinds of alignments with parts and known deletions, told apart by corr."""
    both = original.withColumn("corr", F.lit(False)).unionByName(corrected.withColumn("corr", F.lit(True)))
    return with_known_deletions(with_parts(both, min_intron), annotated, "corr")


def _tagged(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Both kinds of alignments; qname becomes a struct of the read and whether it is the corrected one."""
    tag = lambda rows, flag: rows.withColumn("qname", F.struct(F.col("qname").alias("acc"), F.lit(flag).alias("corr")))
    return tag(original, False).unionByName(tag(corrected, True))


def _lengths(rows: DataFrame, reads: DataFrame, corrected_reads: DataFrame) -> DataFrame:
    """rows (acc, corr) with read_length, made_length among the corrected reads, and whether a read is aligned as original (in_orig) and as corrected one (in_corr)."""
    made = corrected_reads.select(F.col("qname").alias("acc"), F.col("read_length").alias("made_length"))
    known = reads.select(F.col("qname").alias("acc"), "read_length").join(made, "acc", "left")
    here = Window.partitionBy("acc")
    rows = rows.withColumn("in_orig", F.max(~F.col("corr")).over(here)).withColumn("in_corr", F.max("corr").over(here))
    return rows.join(known, "acc", "left")


def _by_type(rows: DataFrame) -> DataFrame:
    """rows of _lengths with read_type, their read_length and is_unaligned_in_other_method; reads missing among the corrected ones stand in with their original."""
    stand_in = ~F.col("corr") & F.col("made_length").isNull() & F.col("read_length").isNotNull() & ~F.col("in_corr")
    kinds = F.when(F.col("corr"), F.array(F.lit("corrected"))).when(stand_in, F.array(F.lit("original"), F.lit("corrected"))).otherwise(F.array(F.lit("original")))
    out = rows.withColumn("read_type", F.explode(kinds))
    alone = F.when(F.col("read_type") == "original", ~F.col("in_corr")).otherwise(~F.col("in_orig"))
    length = F.when(F.col("read_type") == "corrected", F.coalesce("made_length", "read_length")).otherwise(F.col("read_length"))
    return out.withColumn("is_unaligned_in_other_method", alone.cast("int")).withColumn("read_length", length).drop("corr", "made_length", "in_orig", "in_corr")


def per_read_transcriptome(original: DataFrame, corrected: DataFrame, reads: DataFrame, corrected_reads: DataFrame) -> DataFrame:
    """Per read of both types: acc, read_type, ins, del, subs, matches, error_rate, read_length, aligned_length, chr_id (all its references, ':' between)."""

    both = _tagged(original, corrected)
    first = both.withColumn("__rn", F.row_number().over(Window.partitionBy("qname").orderBy("ord"))).filter("__rn = 1").drop("__rn")
    rows = E.with_error_counts(first).join(E.locations(both), "qname")
    rows = rows.select(F.col("qname").alias("acc"), "ins", "del", "subs", "matches", error_percent().alias("error_rate"), (F.col("ins") + F.col("del") + F.col("subs") + F.col("matches")).alias("aligned_length"), F.col("locations").alias("chr_id"))
    rows = rows.withColumn("corr", F.col("acc.corr")).withColumn("acc", F.col("acc.acc"))
    return _by_type(_lengths(rows, reads, corrected_reads)).drop("is_unaligned_in_other_method")


def location_stability(results: DataFrame) -> DataFrame:
    """One row over a per-read table: reads that changed place, lost their alignment, have more errors; both counts and upper medians of the error rate."""
    o, c = (results.filter(F.col("read_type") == t) for t in ("original", "corrected"))
    cols = ["chr_id", "reference_start", "reference_end", "error_rate"]
    both = o.select("acc", *[F.col(x).alias(f"o_{x}") for x in cols]).join(c.select("acc", F.lit(1).alias("found"), *[F.col(x).alias(f"c_{x}") for x in cols]), "acc", "left")
    inside = lambda x: F.col(x).between(F.col("o_reference_start"), F.col("o_reference_end"))
    same = (F.col("o_chr_id") == F.col("c_chr_id")) & (inside("c_reference_start") | inside("c_reference_end"))
    counts = both.agg(
        F.count_if(F.col("found").isNotNull() & ~same).alias("changed"), F.count_if(F.col("found").isNull()).alias("unaligned"), F.count_if(F.col("c_error_rate") > F.col("o_error_rate")).alias("broken"), F.count("*").alias("originals"),
    )
    middle = E.values_at(results, "error_rate", ["read_type"], {"middle": F.floor(F.col("n") / 2)})
    of = lambda t, c: F.max(F.when(F.col("read_type") == t, F.col(c)))
    medians = middle.agg(of("original", "middle").alias("median_original"), of("corrected", "middle").alias("median_corrected"), of("corrected", "n").alias("corrected"))
    return counts.join(medians)  # one row each


def quality_gate(alignments: DataFrame, rname, starts: tuple[int, int], ends: tuple[int, int], identity: float = 0.95, coverage: float = 0.99) -> DataFrame:
    """alignments on a reference whose identity, coverage, start and end are within bounds; with identity and coverage.

    Of the query's length, mismatches, insertions, deletions and soft clips count against identity, soft clips against coverage.
    """
    ops = operations(F.col("cigar"))
    size = lambda kinds: F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda acc, o: acc + o["n"])
    length = size("=XMIS")
    rows = alignments.withColumn("identity", F.round((length - size("XIDS")) / length, 6)).withColumn("coverage", F.round((length - size("S")) / length, 6)).withColumn("stop", reference_end(F.col("cigar"), F.col("start")))
    return rows.filter((F.col("rname") == rname) & (F.col("identity") >= identity) & (F.col("coverage") >= coverage) & F.col("start").between(*starts) & F.col("stop").between(*ends))


def alignment_lines(cigar: Column, query: Column, target: Column, start: Column) -> Column:
    """(target_line, match_line, query_line) of a SAM alignment: | for equal bases, * for others, a space beside gaps, X over what is clipped.

    Before and after the aligned part stand the query's clipped bases and the target's further ones, padded with gaps.
    """
    ops = operations(cigar)
    lead = F.when(F.get(ops, F.lit(0))["op"] == "S", F.get(ops, F.lit(0))["n"]).otherwise(F.lit(0))
    last = F.element_at(ops, -1)
    trail = F.when((F.size(ops) > 1) & (last["op"] == "S"), last["n"]).otherwise(F.lit(0))
    inner = F.filter(ops, lambda o: o["op"] != "S")
    begin = F.struct((lead + 1).alias("q"), (start + 1).alias("t"), F.lit("").alias("a"), F.lit("").alias("m"), F.lit("").alias("b"))

    def step(acc: Column, o: Column) -> Column:
        in_q, in_t, n = ~o["op"].isin("D", "N"), o["op"] != "I", o["n"]
        gap, q, t = F.repeat(F.lit("-"), n), F.substring(query, acc["q"], n), F.substring(target, acc["t"], n)
        marks = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.upper(F.substring(q, i, F.lit(1))) == F.upper(F.substring(t, i, F.lit(1))), "|").otherwise("*")), "")
        return F.struct(
            (acc["q"] + F.when(in_q, n).otherwise(0)).alias("q"), (acc["t"] + F.when(in_t, n).otherwise(0)).alias("t"),
            F.concat(acc["a"], F.when(in_t, t).otherwise(gap)).alias("a"), F.concat(acc["m"], F.when(in_q & in_t, marks).otherwise(F.repeat(F.lit(" "), n))).alias("m"), F.concat(acc["b"], F.when(in_q, q).otherwise(gap)).alias("b"),
        )

    def finish(acc: Column) -> Column:
        pad = lambda n: F.repeat(F.lit("-"), F.greatest(n, F.lit(0)))
        more = F.length(target) - acc["t"] + 1
        return F.struct(
            F.concat(pad(lead - start), F.substring(target, F.lit(1), start), acc["a"], F.substring(target, acc["t"], F.greatest(more, F.lit(0))), pad(trail - more)).alias("target_line"),
            F.concat(F.repeat(F.lit("X"), F.greatest(lead, start)), acc["m"], F.repeat(F.lit("X"), F.greatest(trail, more))).alias("match_line"),
            F.concat(pad(start - lead), F.substring(query, F.lit(1), lead), acc["b"], F.substring(query, acc["q"], trail), pad(more - trail)).alias("query_line"),
        )

    return F.aggregate(inner, begin, step, finish)


def mask_errors(query_aln: Column, target_aln: Column, mask: Column) -> Column:
    """(ins, del, subs, aligned) over the columns of a gapped pair where mask (an array of 0 and 1) is 1."""
    zipped = F.filter(F.arrays_zip(F.filter(F.split(query_aln, ""), lambda c: c != "").alias("q"), F.filter(F.split(target_aln, ""), lambda c: c != "").alias("t"), mask.alias("m")), lambda x: x["m"] == 1)
    n = lambda test: F.size(F.filter(zipped, test))
    return F.struct(n(lambda x: x["t"] == "-").alias("ins"), n(lambda x: x["q"] == "-").alias("del"), n(lambda x: (x["q"] != x["t"]) & (x["q"] != "-") & (x["t"] != "-")).alias("subs"), F.size(zipped).alias("aligned"))


def match_blocks(rows: DataFrame, key: str, k: int, least: int) -> DataFrame:
    """key, pos, inside: whether some window of k + 1 columns of the target that covers a column from either side holds `least` matches.

    rows: key, query_aln, target_aln of one alignment each. Columns where the target has a gap take their neighbour's state.
    """
    chars = rows.select(key, F.length("target_aln").alias("n"), F.posexplode(F.split("query_aln", "")).alias("pos", "q"), F.col("target_aln")).withColumn("t", F.substring("target_aln", F.col("pos") + 1, F.lit(1))).filter("q <> ''")
    solid = chars.filter("t <> '-'").withColumn("hit", (F.col("q") == F.col("t")).cast("int"))
    order = Window.partitionBy(key).orderBy("pos")
    back, ahead = order.rowsBetween(-k, 0), order.rowsBetween(0, k)
    full = lambda w: F.when(F.count("*").over(w) > k, F.sum("hit").over(w))
    wide = solid.withColumn("back", full(back)).withColumn("ahead", full(ahead))
    # Columns too near an end for a window of their own take the state of the last one on their side.
    last = F.last("ahead", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("back", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return wide.select(key, "pos", (F.greatest(first, last) >= least).alias("inside"))


def gap_blocks(rows: DataFrame, key: str, least: int = 10) -> DataFrame:
    """key, start, stop of stretches between two aligned columns in which the query lacks `least` bases of the target or more."""
    chars = rows.select(key, F.col("target_aln"), F.posexplode(F.split("query_aln", "")).alias("pos", "q")).withColumn("t", F.substring("target_aln", F.col("pos") + 1, F.lit(1))).filter("q <> '' and t <> '-'")
    runs = chars.withColumn("run", F.sum((F.col("q") != "-").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    found = runs.groupBy(key, "run").agg(F.min(F.when(F.col("q") != "-", F.col("pos"))).alias("at"), F.count_if(F.col("q") == "-").alias("lost"))
    closed = found.withColumn("stop", F.lead("at").over(Window.partitionBy(key).orderBy("run")))
    return closed.filter((F.col("lost") >= least) & F.col("stop").isNotNull()).select(key, F.coalesce(F.col("at") + 1, F.lit(0)).alias("start"), "stop")


def same_isoform(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(qname, tx) of reads whose introns are as many as the transcript's and hold each of them.

    reads: qname, rname, start, stop; transcripts: chrom, tx, start, stop.
    """
    own = reads.select("qname", "rname", "start", "stop").distinct().withColumn("n", F.count("*").over(Window.partitionBy("qname", "rname")))
    theirs = transcripts.select(F.col("chrom").alias("rname"), "tx", "start", "stop").distinct().withColumn("m", F.count("*").over(Window.partitionBy("rname", "tx")))
    # A transcript of more introns than the read, or of fewer, isn't its own.
    met = own.join(theirs.withColumnRenamed("m", "n"), ["rname", "start", "stop", "n"]).groupBy("qname", "rname", "tx", "n").agg(F.count("*").alias("common"))
    return met.filter("common = n").select("qname", "tx")


def chain_groups(junctions: DataFrame) -> DataFrame:
    """Reads with one chain of introns: rname, chain, reads, accs."""
    chains = junctions.groupBy("qname", "rname").agg(E.chain("start", "stop").alias("chain"))
    return chains.groupBy("rname", "chain").agg(F.count("*").alias("reads"), F.array_join(F.array_sort(F.collect_set(F.col("qname").cast("string"))), ",").alias("accs"))


def novel_chains(junctions: DataFrame, annotated: DataFrame) -> DataFrame:
    """Chains of introns with whether an annotated transcript confirms them."""
    known = annotated.groupBy("chrom", "tx").agg(E.chain("start", "stop").alias("chain")).select(F.col("chrom").alias("rname"), "chain", F.lit(True).alias("confirmed")).distinct()
    return chain_groups(junctions).select("rname", "chain", "reads").join(known, ["rname", "chain"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def similarity_matrix(seqs: DataFrame, key: str, seq: str, names: list) -> DataFrame:
    """Edit distances of all pairs as a matrix, above 99 null: key and a column d_<name> for each name."""
    rows, cols = seqs.select(key, F.col(seq).alias("a")), seqs.select(F.col(key).alias("__other"), F.col(seq).alias("b"))
    pairs = rows.join(cols, F.col("__other").isin(*names)).withColumn("d", F.levenshtein("a", "b", 99))
    return pairs.groupBy(key).agg(*[F.max(F.when((F.col("__other") == n) & (F.col("d") >= 0), F.col("d"))).alias(f"d_{n}") for n in names])


def abundance_ratios(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Every pair of a small table of counts with the ratio of the first to the second: key, other, ratio."""
    other = counts.select(F.col(key).alias("other"), F.col(n).alias("__n"))
    return counts.join(F.broadcast(other)).select(key, "other", F.round(F.col(n) / F.col("__n"), 6).alias("ratio"))


def mixed_sample(reads: DataFrame, key: str, kind: str, minor, major, depth: int, p: float, seed: str) -> DataFrame:
    """int(p * depth) reads of the minor kind and int((1 - p) * depth) of the major one, the same on every run."""
    parts = [E.sample_by_hash(reads.filter(F.col(kind) == k), n, key, seed) for k, n in ((minor, int(p * depth)), (major, int((1 - p) * depth)))]
    return parts[0].unionByName(parts[1])


def truth_errors(reads: DataFrame, refs: DataFrame, key: str, neutral: str, forms: list[str], ref_key: str, ref_seq: str) -> DataFrame:
    """key, truth, and for each form <form>_ed, <form>_len, <form>_rate: infix distances to the reference that the neutral form fits best.

    Of equal references the one whose name comes first counts. Only pairs that share a segment are aligned (operators.nearest).
    """
    from .udfs import infix_udf

    few = refs.filter(F.col(ref_seq).isNotNull()).select(F.col(ref_key).alias("__ref"), F.col(ref_seq).alias("__seq"))
    first = few.agg(F.min("__ref").alias("__first"))
    texts = numbered(reads.filter(F.col(neutral) != ""), neutral, "t", "tid")
    longest = texts.agg(F.max(F.length("t"))).first()[0] or 0
    pairs = nearest_pairs(texts, few.toDF("rid", "rt"), longest + 1, lambda t, rt, e: infix_udf(t, rt), infix=True)
    best = pairs.groupBy("tid").agg(F.min("rid").alias("rid")).join(texts, "tid").crossJoin(F.broadcast(first)).select(F.col("t").alias("__t"), F.coalesce("rid", "__first").alias("__ref"))
    rows = reads.join(best, reads[neutral] == best["__t"]).join(few, "__ref")
    out = [F.col(key), F.col("__ref").alias("truth")]
    for f in forms:
        rows = rows.withColumn(f"{f}_ed", infix_udf(f, "__seq"))
        out += [F.col(f"{f}_ed"), F.length(f).alias(f"{f}_len"), F.round(F.col(f"{f}_ed") / F.length(f), 6).alias(f"{f}_rate")]
    return rows.select(*out)


def unambiguous(reads: DataFrame, seq: str, one: str, two: str, least: int) -> DataFrame:
    """reads whose distances to two references differ by `least` or more; a distance is the smaller of either text as an infix of the other."""
    from .udfs import infix_udf

    both = lambda ref: F.least(infix_udf(seq, ref), infix_udf(ref, seq))
    rows = reads.withColumn("ed_one", both(one)).withColumn("ed_two", both(two))
    return rows.filter(F.abs(F.col("ed_one") - F.col("ed_two")) >= least)


def refined(tied: DataFrame, reads: DataFrame, refs: DataFrame, key: str, ref_key: str, seq: str) -> DataFrame:
    """Of tied references (key, ref) those with the fewest errors in a semi-global alignment (2, -2, gaps 2 and 1): key, ref, del, ins, subs. Ties stay."""
    from .udfs import gentle_udf

    rows = tied.join(reads.select(key, F.col(seq).alias("__q")), key).join(refs.select(ref_key, F.col(seq).alias("__t")), ref_key).withColumn("__a", gentle_udf("__q", "__t"))
    counted = rows.select(key, ref_key, F.length("__q").alias("__n"), *pair_errors(F.col("__a.query_aln"), F.col("__a.target_aln")))
    least = Window.partitionBy(key).orderBy(F.col("del") + F.col("ins") + F.col("subs"))
    return counted.filter(F.col("del") + F.col("ins") + F.col("subs") <= F.col("__n")).withColumn("__rk", F.rank().over(least)).filter("__rk = 1").select(key, ref_key, "del", "ins", "subs")


def pair_errors(query_aln: Column, target_aln: Column) -> list[Column]:
    """ins, del, subs, matches of two gapped strings."""
    every = F.arrays_zip(F.split(query_aln, "").alias("q"), F.split(target_aln, "").alias("t"))
    n = lambda test: F.size(F.filter(every, test))
    solid = lambda x: (x["q"] != "-") & (x["t"] != "-") & (x["q"] != "")
    return [n(lambda x: x["t"] == "-").alias("ins"), n(lambda x: x["q"] == "-").alias("del"), n(lambda x: solid(x) & (x["q"] != x["t"])).alias("subs"), n(lambda x: solid(x) & (x["q"] == x["t"])).alias("matches")]


def profiled(rows: DataFrame, seq: str, true: str) -> DataFrame:
    """rows with read_length (of the true text), err, ins, del, subs, matches and err_rate, in percent of the true text and what was inserted."""
    from .udfs import path_udf

    aligned = rows.withColumn("__a", path_udf(seq, true))
    counted = aligned.select("*", *pair_errors(F.col("__a.query_aln"), F.col("__a.target_aln")), F.col("__a.ed").alias("err"), F.length(true).alias("read_length")).drop("__a")
    return counted.withColumn("err_rate", F.round(100 * (F.col("subs") + F.col("ins") + F.col("del")) / (F.col("read_length") + F.col("ins")), 2))
