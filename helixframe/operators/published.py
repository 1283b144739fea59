"""Result tables with just the columns that published result files have, for sources.write_results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import operations, total
from ..session import cut
from . import assessment as A
from . import evaluation as E


def origin(acc: Column) -> Column:
    """What stands before the first _ of a read's name: family|gene|transcript of the sequence it was made from."""
    return F.split_part(acc, F.lit("_"), F.lit(1))


def _field(acc: Column, n: int) -> Column:
    return F.split_part(acc, F.lit("|"), F.lit(n))


def error_profile(corrected: DataFrame, original: DataFrame, true: DataFrame) -> DataFrame:
    """Errors of every corrected read, and of its original, against its true transcript, with three coverages.

    corrected, original: acc (family|gene|transcript_n), seq; true: transcript, seq. Coverages count the original reads of
    the transcript, of the gene and of the family; a read without an original has no original row.
    """
    rows = corrected.select("acc", F.lit("corrected").alias("type"), "seq").unionByName(corrected.select("acc").join(original.select("acc", "seq"), "acc").select("acc", F.lit("original").alias("type"), "seq"))
    keys = {"transcript_cov": lambda c: origin(_field(c, 3)), "gene_cov": lambda c: _field(c, 2), "gene_fam_cov": lambda c: _field(c, 1)}
    named = rows.withColumns({f"__{n}": of(F.col("acc")) for n, of in keys.items()})
    named = named.join(true.select(F.col("transcript").alias("__transcript_cov"), F.col("seq").alias("true")), "__transcript_cov")
    for n, of in keys.items():
        named = named.join(original.groupBy(of(F.col("acc")).alias(f"__{n}")).agg(F.count("*").alias(n)), f"__{n}", "left")
    done = A.profiled(named.fillna(0, list(keys)), "seq", "true")
    return done.select(F.col("acc").alias("read"), "read_length", "err", "ins", "del", "subs", "matches", "err_rate", "type", *keys)


def perturbation(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """The nearest reference of every read of every experiment, whether it is the one that the read was made from, and whether that is the minor one.

    reads: id, type, Depth, p, acc (family|gene|transcript_n), seq; refs: ref_acc, seq. A row for each read that has a reference at fewer
    than 1000 edits; of equal ones the first by name counts. Abundance counts the reads of an experiment made from one
    sequence; the error rate is over the length of the nearest reference.
    """
    near = E.nearest(reads.select("id", "acc", "seq").withColumn("key", F.struct("id", "acc")), refs, "key", "ref_acc", "seq", "seq")
    made = origin(F.col("acc"))
    abundance = reads.groupBy("id", made.alias("origin")).agg(F.count("*").alias("abundance"))
    rows = near.select("key.*", "ref_acc", "ed").join(reads.select("id", "type", "Depth", "p", "acc"), ["id", "acc"]).withColumn("origin", made).join(abundance, ["id", "origin"])
    rows = rows.join(refs.select("ref_acc", F.length("seq").alias("n")), "ref_acc")
    return rows.select(
        "id", "type", "Depth", "p", F.col("acc").alias("q_acc"), F.col("ref_acc").alias("r_acc"), F.col("ed").alias("total_errors"), F.round(100 * F.col("ed") / F.col("n"), 4).alias("error_rate"), "abundance",
        (_field(F.col("origin"), 3) == F.col("ref_acc")).cast("int").alias("preserved"), F.contains("origin", F.lit("minor")).cast("int").alias("minor"),
    )


def location_stability(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """For each read that is aligned before and after: its cluster's depth and number of isoforms, from its name, and whether it left all its references.

    Both: acc (name,depth,isoforms), chr_id (references, with : between them).
    """
    part = lambda n: F.split_part("acc", F.lit(","), F.lit(n)).cast("int")
    ids = lambda c: F.split(c, ":")
    both = original.select("acc", F.col("chr_id").alias("o")).join(corrected.select("acc", F.col("chr_id").alias("c")), "acc")
    return both.select(part(2).alias("nr_reads"), part(3).alias("nr_isoforms"), (~F.arrays_overlap(ids("o"), ids("c"))).cast("int").alias("is_overcorrected"))


def aligned_coverage(alignments: DataFrame, least: int = 10) -> DataFrame:
    """Reads of every transcript by primary alignments: unambiguous from a mapping quality of `least` on, else ambiguous.

    alignments: qname, rname, flag, mapq.
    """
    kind = F.when(F.col("mapq") >= least, "unambiguous").otherwise("ambiguous")
    return alignments.filter("flag in (0, 16)").groupBy(F.col("rname").alias("transcript"), kind.alias("type")).agg(F.count_distinct("qname").alias("depth"))


def _spread(rows: DataFrame, value: str, prefix: str) -> DataFrame:
    """set, n, <prefix>_median, <prefix>_p90 of percentages."""
    n = F.col("n")
    found = E.values_at(rows.select("set", value), value, ["set"], {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2), "__p90": F.least(n - 1, F.floor(n * 0.9))})
    return found.select("set", "n", F.round((F.col("__low") + F.col("__high")) / 2, 6).alias(f"{prefix}_median"), F.round("__p90", 6).alias(f"{prefix}_p90"))


def scored(alignments: DataFrame) -> DataFrame:
    """set, read, nm, aligned, read_len of the first primary alignment of every read; those that align nothing are left out.

    alignments: set, read, ord, flag, cigar (=, X, I, D, S, H, M, N) and nm; without nm it is what X, I and D hold. Only first
    alignments have their CIGAR parsed, once.
    """
    names = [c for c in ("cigar", "nm") if c in alignments.columns]
    first = alignments.filter(F.col("flag").bitwiseAND(0x904) == 0).groupBy("set", "read").agg(F.min_by(F.struct(*names), "ord").alias("a")).select("set", "read", "a.*")
    # An array of one, so that the operations are bound to a variable: a filter on a column would have them parsed again.
    lengths = F.get(F.transform(F.array(operations(F.col("cigar"))), lambda o: F.struct(total(o, "M=XI").alias("aligned"), total(o, "M=XISH").alias("read_len"), (F.col("nm") if "nm" in names else total(o, "XID")).alias("nm"))), F.lit(0))
    return first.select("set", "read", F.explode_outer(F.array(lengths)).alias("x")).select("set", "read", "x.nm", "x.aligned", "x.read_len").filter("aligned > 0")


def _everywhere(rows: DataFrame, sets: int) -> DataFrame:
    """Rows of reads that every set has; made once, written narrow, as several aggregates read them."""
    counted = rows.filter("read is not null").withColumn("__sets", F.count("*").over(Window.partitionBy("read")))
    return cut(counted.filter(F.col("__sets") == sets).drop("__sets"), "scored")


def genome_accuracy(alignments: DataFrame, sets: int) -> DataFrame:
    """For each set of reads, over reads that all `sets` of them align: set, n, error and aligned percentages (mean, median, 90th percentile by place), and the pooled error."""
    rows = _everywhere(scored(alignments), sets).withColumns({"__e": 100.0 * F.col("nm") / F.col("aligned"), "__a": 100.0 * F.col("aligned") / F.col("read_len")})
    means = rows.groupBy("set").agg(F.round(F.avg("__e"), 6).alias("err_mean"), F.round(F.avg("__a"), 6).alias("aln_mean"), F.round(100.0 * F.sum("nm") / F.sum("aligned"), 6).alias("err_total"))
    found = _spread(rows, "__e", "err").join(_spread(rows, "__a", "aln").drop("n", "aln_p90"), "set").join(means, "set")
    return found.select("set", "n", "err_mean", "err_median", "err_p90", "aln_mean", "aln_median", "err_total")


def paired_accuracy(alignments: DataFrame, base: str, sets: int) -> DataFrame:
    """set, mean_delta (percentage points), better, worse, equal of every other set against a base, read by read, over reads that all sets align."""
    rows = _everywhere(scored(alignments), sets).select("set", "read", (100.0 * F.col("nm") / F.col("aligned")).alias("e"))
    own = F.max(F.when(F.col("set") == base, F.col("e"))).over(Window.partitionBy("read"))
    other = rows.withColumn("b", own).filter((F.col("set") != base) & F.col("b").isNotNull())
    return other.groupBy("set").agg(F.round(F.avg(F.col("e") - F.col("b")), 6).alias("mean_delta"), F.count_if(F.col("e") < F.col("b")).alias("better"), F.count_if(F.col("e") > F.col("b")).alias("worse"), F.count_if(F.col("e") == F.col("b")).alias("equal"))
