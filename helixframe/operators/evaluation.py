"""Relational operators over alignments, read sets and result tables. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import operations, reference_places, total
from ..functions.sequences import reverse_complement
from .nearest import nearest_pairs, numbered

QUANTILES = (0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)


def with_error_counts(alignments: DataFrame, min_intron: int | None = None) -> DataFrame:
    """ins, del, subs, matches, introns, clipped, aligned and error_rate from a column `cigar`.

    With min_intron, deletions of that length or more aren't errors.
    """
    ops = operations(F.col("cigar"))
    return (
        alignments.withColumn("__ops", ops)
        .withColumn("ins", total(F.col("__ops"), "I")).withColumn("del", total(F.col("__ops"), "D", min_intron))
        .withColumn("subs", total(F.col("__ops"), "X")).withColumn("matches", total(F.col("__ops"), "="))
        .withColumn("introns", F.size(F.filter("__ops", lambda o: o["op"] == "N")))
        .withColumn("clipped", total(F.col("__ops"), "SH")).withColumn("aligned", total(F.col("__ops"), "M=XI")).drop("__ops")
        .withColumn("error_rate", F.round((F.col("ins") + F.col("del") + F.col("subs")) / (F.col("ins") + F.col("del") + F.col("subs") + F.col("matches")), 6))
    )


def primary(alignments: DataFrame, *more: str) -> DataFrame:
    """One alignment of each read (and of what else more columns tell apart): the largest identity * matches, then the later one."""
    identity = F.col("matches") / (F.col("ins") + F.col("del") + F.col("subs") + F.col("matches"))
    order = Window.partitionBy("qname", *more).orderBy((identity * F.col("matches")).desc(), F.col("ord").desc())
    return alignments.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def locations(alignments: DataFrame) -> DataFrame:
    """Per read the references of its first alignment and of those with the same CIGAR: qname, locations."""
    first = F.first("cigar").over(Window.partitionBy("qname").orderBy("ord"))
    same = alignments.withColumn("__first", first).filter(F.col("cigar") == F.col("__first"))
    return same.groupBy("qname").agg(F.array_join(F.array_sort(F.collect_set(F.col("rname").cast("string"))), ":").alias("locations"))


def gaps(alignments: DataFrame, op: str = "N") -> DataFrame:
    """Reference intervals [start, stop) of operations of one kind: introns (N) or deletions (D)."""
    placed = F.filter(reference_places(operations(F.col("cigar")), F.col("start")), lambda o: o["op"] == op)
    # The outer form of explode, and only texts that hold the sign: for the plain form the optimizer infers a filter that parses every CIGAR once more.
    rows = alignments.filter(F.contains("cigar", F.lit(op))).select("qname", "ord", "rname", F.explode_outer(placed).alias("o")).filter("o is not null")
    return rows.select("qname", "ord", "rname", F.col("o.pos").alias("start"), (F.col("o.pos") + F.col("o.n")).alias("stop"))


def introns_of(exons: DataFrame) -> DataFrame:
    """Introns between the exons of each transcript: chrom, tx, start, stop."""
    after = F.lead("exon_start").over(Window.partitionBy("chrom", "tx").orderBy("exon_start"))
    return exons.withColumn("stop", after).filter("stop is not null").select("chrom", "tx", F.col("exon_end").alias("start"), "stop")


def classify_splices(reads: DataFrame, junctions: DataFrame, annotated: DataFrame) -> DataFrame:
    """FSM, NIC, ISM, NNC or NO_SPLICE of every read.

    reads: qname; junctions: qname, rname, start, stop of reads; annotated: chrom, tx, start, stop. A read is FSM
    if its chain of introns is that of a transcript; else, if all junctions are known (as a pair, or both ends as ends of any intron), NIC
    if some pair is new and ISM if none is; else NNC.
    """
    pairs = annotated.select(F.col("chrom").alias("rname"), "start", "stop", F.lit(True).alias("pair")).distinct()
    site = annotated.select(F.col("chrom").alias("rname"), F.explode(F.array("start", "stop")).alias("at")).distinct()
    left, right = (site.select("rname", F.col("at").alias(c), F.lit(True).alias(n)) for c, n in (("start", "left"), ("stop", "right")))
    seen = junctions.join(pairs, ["rname", "start", "stop"], "left").join(left, ["rname", "start"], "left").join(right, ["rname", "stop"], "left")
    known = F.coalesce(F.col("pair"), F.lit(False)) | (F.coalesce(F.col("left"), F.lit(False)) & F.coalesce(F.col("right"), F.lit(False)))
    by_read = seen.groupBy("qname", "rname").agg(
        F.count("*").alias("n"), F.bool_and(known).alias("known"), F.bool_or(F.col("pair").isNull()).alias("combination"),
        chain("start", "stop").alias("chain"),
    )
    chains = annotated.groupBy("chrom", "tx").agg(chain("start", "stop").alias("chain")).select(F.col("chrom").alias("rname"), "chain", F.lit(True).alias("fsm")).distinct()
    found = by_read.join(chains, ["rname", "chain"], "left")
    label = (
        F.when(F.col("n").isNull(), "NO_SPLICE").when(F.coalesce("fsm", F.lit(False)), "FSM").when(F.col("known") & F.col("combination"), "NIC")
        .when(F.col("known"), "ISM").otherwise("NNC")
    )
    return reads.join(found, "qname", "left").select("qname", F.coalesce("n", F.lit(0)).cast("long").alias("junctions"), label.alias("class"))


def chain(start: str, stop: str) -> Column:
    """The signature of a set of intervals, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, stop))), lambda x: F.concat_ws("-", x[start], x[stop])), ",")


def mask_known_gaps(deletions: DataFrame, annotated: DataFrame) -> DataFrame:
    """Deletions that aren't annotated introns."""
    known = annotated.select(F.col("chrom").alias("rname"), "start", "stop").distinct()
    return deletions.join(known, ["rname", "start", "stop"], "left_anti")


def counted_order(values: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    """Distinct values of the columns `by` for each group, in their order: __from and __to, the places (from 0) that rows with them take, and __n rows in all.

    Rows are counted before they are put in order, so what is sorted in one place are a group's distinct values.
    """
    columns = list(dict.fromkeys([*group, *by]))
    counts = values.groupBy(*columns).agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*group)
    held = counts.withColumn("__to", F.sum("__c").over(whole.orderBy(*by))).withColumn("__n", F.sum("__c").over(whole))
    return held.withColumn("__from", F.col("__to") - F.col("__c")).drop("__c")


def values_at(values: DataFrame, by: str, group: list[str], places: dict[str, Column]) -> DataFrame:
    """group, n and the values of a column at given places of each group's order; places are expressions of n."""
    held = counted_order(values, [by], group).withColumnRenamed("__n", "n")
    inside = lambda at: (at >= F.col("__from")) & (at < F.col("__to"))
    return held.groupBy(*group, "n").agg(*[F.max(F.when(inside(at), F.col(by))).alias(name) for name, at in places.items()])


def order_statistics(values: DataFrame, by: str, columns: list[str], group: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """columns at positions int(q * n) (n - 1 for the last) of the order of `by`, for each group. Ties by the columns."""
    held = counted_order(values, [by, *columns], group)
    spots = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.least(F.floor(F.lit(q) * F.col("__n")), F.col("__n") - 1).alias("pos")) for q in quantiles]))
    here = (F.col("s.pos") >= F.col("__from")) & (F.col("s.pos") < F.col("__to"))
    return held.select(*group, *columns, "__from", "__to", spots.alias("s")).filter(here).select(*group, F.col("s.q").alias("quantile"), *columns)


def best_fraction_sums(values: DataFrame, by: str, columns: list[str], group: list[str], q: float) -> DataFrame:
    """Sums over the share q of rows with the smallest `by`."""
    held = counted_order(values, [by, *columns], group)
    taken = F.least(F.col("__to"), F.floor(F.col("__n") * q)) - F.col("__from")
    return held.withColumn("__taken", taken).filter(F.col("__taken") > 0).groupBy(*group).agg(*[F.sum(F.col(c) * F.col("__taken")).alias(c) for c in columns])


def paired_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of b - a over common keys, and how many got better (smaller), worse, equal."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return both.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_delta"), F.count_if(F.col("b") < F.col("a")).alias("better"),
        F.count_if(F.col("b") > F.col("a")).alias("worse"), F.count_if(F.col("b") == F.col("a")).alias("equal"),
    )


def same_region(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Reads with whether the corrected locus starts or stops inside the original's on the same reference.

    A corrected locus that contains the original counts as outside, as in the published tables.
    """
    o = original.select("qname", F.col("rname").alias("orname"), F.col("start").alias("ostart"), F.col("stop").alias("ostop"))
    inside = lambda c: (F.col(c) >= F.col("ostart")) & (F.col(c) <= F.col("ostop"))
    return corrected.join(o, "qname").select("qname", ((F.col("rname") == F.col("orname")) & (inside("start") | inside("stop"))).alias("same"))


def sample_by_hash(df: DataFrame, n: int, key: str, seed: str, strata: list[str] | None = None) -> DataFrame:
    """n rows (of each stratum) without replacement, the same on every run: those with the smallest hash of the key."""
    draw = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    if not strata:
        return df.orderBy(draw, key).limit(n)
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))).filter(F.col("__rn") <= n).drop("__rn")


def numbered_clusters(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Clusters of at least `least` rows, numbered from 0, largest first, ties by name."""
    sizes = df.groupBy(key).agg(F.count("*").alias("reads")).filter(F.col("reads") >= least)
    return sizes.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("reads"), key)) - 1).cast("int"))


def islands(positions: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of consecutive positions: key, island, first, last, n."""
    order = Window.partitionBy(key).orderBy(pos)
    jump = F.coalesce((F.col(pos) > F.lag(pos).over(order) + 1).cast("int"), F.lit(0))
    numbered = positions.select(key, pos).distinct().withColumn("__jump", jump).withColumn("island", F.sum("__jump").over(order))
    return numbered.groupBy(key, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))


def position_frequencies(rows: DataFrame, group: list[str], seq: str, alphabet: str = "ACGTUN-") -> DataFrame:
    """Counts of each character for each column of equally long rows: group, col, one column a character."""
    chars = rows.select(*group, F.posexplode(F.split(seq, "")).alias("col", "ch")).filter("ch <> ''")
    return chars.groupBy(*group, "col").agg(*[F.count_if(F.col("ch") == c).alias({"-": "gap"}.get(c, c)) for c in alphabet])


def column_consensus(rows: DataFrame, group: list[str], seq: str) -> DataFrame:
    """The most frequent character of every column, the smaller of equal ones, joined: group, consensus."""
    chars = rows.select(*group, F.posexplode(F.split(seq, "")).alias("col", "ch")).filter("ch <> ''")
    counts = chars.groupBy(*group, "col", "ch").agg(F.count("*").alias("n"))
    best = counts.groupBy(*group, "col").agg(F.min(F.struct((-F.col("n")).alias("m"), "ch")).alias("b"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", F.col("b.ch").alias("ch")))), lambda x: x["ch"])
    return best.groupBy(*group).agg(F.array_join(ordered, "").alias("consensus"))


def redundant(seqs: DataFrame, key: str, seq: str, k: int = 16, both_strands: bool = True) -> DataFrame:
    """Keys of sequences contained, as they are or (both_strands) as reverse complement, in a longer one or in an equally long one with a smaller key.

    A sequence can only be inside those that hold its first k-mer, so the join is on k-mers, not on all pairs;
    sequences shorter than k are looked for by as many bases as the shortest one has.
    """
    short = seqs.filter((F.length(seq) > 0) & (F.length(seq) < k)).agg(F.min(F.length(seq))).first()[0] or k
    sizes = sorted({short, k})
    strands = F.array_distinct(F.array(F.col(seq), reverse_complement(F.col(seq)))) if both_strands else F.array(F.col(seq))
    probe = seqs.filter(F.length(seq) > 0).select(F.col(key).alias("a"), F.explode(strands).alias("sa"), F.when(F.length(seq) < k, F.lit(short)).otherwise(F.lit(k)).alias("size")).withColumn("mer", F.expr("substring(sa, 1, size)"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - n + 1, F.lit(1))), lambda i: F.struct(F.lit(n).alias("size"), F.substring(F.col(seq), i, F.lit(n)).alias("mer")))
    held = seqs.select(F.col(key).alias("b"), F.col(seq).alias("sb"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in sizes])))).alias("g")).select("b", "sb", "g.size", "g.mer")
    inside = F.contains("sb", "sa") & ((F.length("sb") > F.length("sa")) | ((F.length("sb") == F.length("sa")) & (F.col("b") < F.col("a"))))
    return probe.join(held, ["size", "mer"]).filter(inside).select(F.col("a").alias(key)).distinct()


def nearest(reads: DataFrame, refs: DataFrame, read_key: str, ref_key: str, text: str, ref_text: str, most: int = 1000, ties: bool = False) -> DataFrame:
    """The reference at the smallest edit distance below `most` of every read: first by key, or all ties.

    Distances are taken between distinct texts, and only of pairs that share a segment (operators.nearest).
    """
    texts, few = numbered(reads, text, "t", "tid"), numbered(refs, ref_text, "rt", "rid")
    scored = nearest_pairs(texts, few, most, lambda t, rt, e: F.levenshtein(t, rt, e))
    named = scored.join(few, "rid").join(refs.select(F.col(ref_key).alias("ref"), F.col(ref_text).alias("rt")), "rt").join(texts, "tid")
    chosen = named.select("t", "ref", "ed") if ties else named.groupBy("t").agg(F.min(F.struct("ed", "ref")).alias("m")).select("t", F.col("m.ref").alias("ref"), F.col("m.ed").alias("ed"))
    return reads.select(F.col(read_key), F.col(text).alias("t")).join(chosen, "t").select(read_key, F.col("ref").alias(ref_key), "ed")
