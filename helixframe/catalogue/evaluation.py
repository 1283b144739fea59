"""Queries over alignments, read sets and result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequences import contains_either, header_parts, last_position, right_closed_bin
from ..operators import evaluation as E
from ..session import table
from ..streaming import windowed_counts
from .registry import ALIGNMENTS, ANNOTATION, alignments, exons, query

OPS = """ops as (
  select qname, ord, rname, start, unnest(range(len(n))) as i, unnest(n)::int as n, unnest(op) as op from (
    select *, regexp_extract_all(cigar, '(\\d+)[=XIDN]', 1) as n, regexp_extract_all(cigar, '\\d+([=XIDN])', 1) as op from aln)),
err as (
  select qname, ord, rname, start, any_value(cigar) as cigar, sum(n) filter (op = 'I')::int as ins, sum(n) filter (op = 'D')::int as del, sum(n) filter (op = 'X')::int as subs, sum(n) filter (op = '=')::int as matches,
    count(*) filter (op = 'N')::int as introns, 0 as clipped, sum(n) filter (op in ('=', 'X', 'I'))::int as aligned from ops join aln using (qname, ord, rname, start) group by 1, 2, 3, 4),
rates as (select *, round((ins + del + subs) / (ins + del + subs + matches)::double, 6) as error_rate from err)""".replace("join aln using (qname, ord, rname, start)", "join (select qname, ord, rname, start, cigar from aln) using (qname, ord, rname, start)")
GAPS = """placed as (
  select qname, ord, rname, op, n, start + coalesce(sum(case when op in ('=', 'X', 'D', 'N') then n else 0 end) over (partition by qname, ord order by i rows between unbounded preceding and 1 preceding), 0)::int as pos from ops),
junctions as (select qname, ord, rname, pos as start, pos + n as stop from placed where op = 'N')"""
INTRONS = """ann as (
  select * from (select chrom, tx, exon_end as start, lead(exon_start) over (partition by chrom, tx order by exon_start) as stop from exons) where stop is not null)"""


def _errors(spark, sf_dir):
    return E.with_error_counts(alignments(spark, sf_dir))


@query("cigar_stats", "select qname, ord, rname, ins, del, subs, matches, introns, aligned, error_rate from rates", (ALIGNMENTS, OPS))
def cigar_stats(spark, sf_dir):
    return _errors(spark, sf_dir).select("qname", "ord", "rname", "ins", "del", "subs", "matches", "introns", "aligned", "error_rate")


@query("identity_coverage_gate", "select qname, ord from rates where matches / (matches + subs + ins)::double >= 0.9", (ALIGNMENTS, OPS))
def identity_coverage_gate(spark, sf_dir):
    return _errors(spark, sf_dir).filter(F.col("matches") / (F.col("matches") + F.col("subs") + F.col("ins")) >= 0.9).select("qname", "ord")


@query(
    "primary_alignment_pick",
    "select qname, ord, rname, matches, error_rate from (select *, row_number() over (partition by qname order by matches / (ins + del + subs + matches)::double * matches desc, ord desc) as rn from rates) where rn = 1", (ALIGNMENTS, OPS),
)
def primary_alignment_pick(spark, sf_dir):
    return E.primary(_errors(spark, sf_dir)).select("qname", "ord", "rname", "matches", "error_rate")


@query(
    "multi_location",
    "select qname, string_agg(distinct rname::varchar, ':' order by rname::varchar) as locations from (select *, first_value(cigar) over (partition by qname order by ord) as c from aln) where cigar = c group by qname", (ALIGNMENTS,),
)
def multi_location(spark, sf_dir):
    return E.locations(alignments(spark, sf_dir))


@query("splice_sites", "select * from junctions", (ALIGNMENTS, OPS, GAPS))
def splice_sites(spark, sf_dir):
    return E.gaps(alignments(spark, sf_dir), "N")


@query("annotated_introns", "select * from ann", (ANNOTATION, INTRONS))
def annotated_introns(spark, sf_dir):
    return E.introns_of(exons(spark, sf_dir))


@query(
    "splice_classification",
    """, st as (select distinct chrom, unnest([start, stop]) as at from ann), seen as (
      select j.*, p.start is not null as pair, exists(select 1 from st where st.chrom = j.rname and st.at = j.start) and exists(select 1 from st where st.chrom = j.rname and st.at = j.stop) as sites
      from junctions j left join (select distinct chrom, start, stop from ann) p on p.chrom = j.rname and p.start = j.start and p.stop = j.stop),
    r as (select qname, rname, count(*) as n, bool_and(pair or sites) as known, bool_or(not pair) as combination, string_agg(start || '-' || stop, ',' order by start, stop) as chain from seen group by 1, 2),
    c as (select distinct chrom as rname, chain from (select chrom, tx, string_agg(start || '-' || stop, ',' order by start, stop) as chain from ann group by 1, 2))
    select q.qname, coalesce(n, 0) as junctions, case when n is null then 'NO_SPLICE' when c.chain is not null then 'FSM' when known and combination then 'NIC' when known then 'ISM' else 'NNC' end as class
    from (select distinct qname from aln) q left join r using (qname) left join c using (rname, chain)""",
    (ALIGNMENTS, OPS, GAPS, ANNOTATION, INTRONS),
)
def splice_classification(spark, sf_dir):
    aln = alignments(spark, sf_dir)
    return E.classify_splices(aln.select("qname").distinct(), E.gaps(aln, "N").drop("ord"), E.introns_of(exons(spark, sf_dir)))


@query("masked_deletions", ", dels as (select qname, ord, rname, pos as start, pos + n as stop from placed where op = 'D') select * from dels d where not exists (select 1 from ann a where a.chrom = d.rname and a.start = d.start and a.stop = d.stop)", (ALIGNMENTS, OPS, GAPS, ANNOTATION, INTRONS))
def masked_deletions(spark, sf_dir):
    return E.mask_known_gaps(E.gaps(alignments(spark, sf_dir), "D"), E.introns_of(exons(spark, sf_dir))).select("qname", "ord", "rname", "start", "stop")


@query("novel_introns", "select rname, start, stop, count(*) as reads, bool_or(exists(select 1 from ann a where a.chrom = j.rname and a.start = j.start and a.stop = j.stop)) as confirmed from junctions j group by 1, 2, 3", (ALIGNMENTS, OPS, GAPS, ANNOTATION, INTRONS))
def novel_introns(spark, sf_dir):
    known = E.introns_of(exons(spark, sf_dir)).select(F.col("chrom").alias("rname"), "start", "stop", F.lit(True).alias("confirmed")).distinct()
    seen = E.gaps(alignments(spark, sf_dir), "N").groupBy("rname", "start", "stop").agg(F.count("*").alias("reads"))
    return seen.join(known, ["rname", "start", "stop"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


@query(
    "error_order_stats",
    """, r as (select rname, ins, del, subs, error_rate, row_number() over (partition by rname order by error_rate, ins, del, subs) - 1 as place, count(*) over (partition by rname) as n from rates),
    q as (select unnest([0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0])::double as quantile)
    select rname, quantile, error_rate, ins, del, subs from r join q on place = least(floor(quantile * n), n - 1)""", (ALIGNMENTS, OPS),
)
def error_order_stats(spark, sf_dir):
    rows = _errors(spark, sf_dir).withColumn("rate", F.col("error_rate"))
    return E.order_statistics(rows, "rate", ["ins", "del", "subs", "error_rate"], ["rname"])


@query(
    "error_summary_top_fraction",
    "select rname, sum(ins)::bigint as ins, sum(del)::bigint as del, sum(subs)::bigint as subs, sum(matches)::bigint as matches from (select *, row_number() over (partition by rname order by error_rate, ins, del, subs, matches) as rn, count(*) over (partition by rname) as n from rates) where rn <= floor(n * 0.9) group by rname", (ALIGNMENTS, OPS),
)
def error_summary_top_fraction(spark, sf_dir):
    return E.best_fraction_sums(_errors(spark, sf_dir), "error_rate", ["ins", "del", "subs", "matches"], ["rname"], 0.9)


@query(
    "accuracy_summary",
    """select rname, count(*) as reads, round(avg(error_rate), 6) as mean, median(error_rate) as median, max(case when rn - 1 = floor(0.9 * n) then error_rate end) as p90, round(sum(ins + del + subs) / sum(ins + del + subs + matches)::double, 6) as pooled, count(*) filter (error_rate = 0) as perfect
    from (select *, row_number() over (partition by rname order by error_rate) as rn, count(*) over (partition by rname) as n from rates) group by rname""", (ALIGNMENTS, OPS),
)
def accuracy_summary(spark, sf_dir):
    w = Window.partitionBy("rname")
    rows = _errors(spark, sf_dir).withColumn("rn", F.row_number().over(w.orderBy("error_rate"))).withColumn("n", F.count("*").over(w))
    wrong = F.col("ins") + F.col("del") + F.col("subs")
    return rows.groupBy("rname").agg(
        F.count("*").alias("reads"), F.round(F.avg("error_rate"), 6).alias("mean"), F.median("error_rate").alias("median"),
        F.max(F.when(F.col("rn") - 1 == F.floor(F.lit(0.9) * F.col("n")), F.col("error_rate"))).alias("p90"), F.round(F.sum(wrong) / F.sum(wrong + F.col("matches")), 6).alias("pooled"), F.count_if(F.col("error_rate") == 0).alias("perfect"),
    )


@query("paired_delta", ", a as (select qname, min(error_rate) as v from rates where introns = 0 group by 1), b as (select qname, min(error_rate) as v from rates where introns > 0 group by 1) select count(*) as n, round(avg(b.v - a.v), 6) as mean_delta, count(*) filter (b.v < a.v) as better, count(*) filter (b.v > a.v) as worse, count(*) filter (b.v = a.v) as equal from a join b using (qname)", (ALIGNMENTS, OPS))
def paired_delta(spark, sf_dir):
    rows = _errors(spark, sf_dir)
    best = lambda cond: rows.filter(cond).groupBy("qname").agg(F.min("error_rate").alias("v"))
    return E.paired_delta(best("introns = 0"), best("introns > 0"), "qname", "v")


@query(
    "read_set_categories",
    """, a as (select distinct qname from rates where error_rate < 0.2), b as (select distinct qname from rates where introns > 0), c as (select distinct qname from aln where rname < 3)
    select coalesce(a.qname, b.qname, c.qname) is not null and a.qname is not null as in_a, b.qname is not null as in_b, c.qname is not null as in_c, count(*) as n from a full join b using (qname) full join c using (qname) group by 1, 2, 3""",
    (ALIGNMENTS, OPS),
)
def read_set_categories(spark, sf_dir):
    """The seven categories of three read sets, from one pass: flags by read, then counts."""
    flags = _errors(spark, sf_dir).groupBy("qname").agg(F.bool_or(F.col("error_rate") < 0.2).alias("in_a"), F.bool_or(F.col("introns") > 0).alias("in_b"), F.bool_or(F.col("rname") < 3).alias("in_c"))
    return flags.filter("in_a or in_b or in_c").groupBy("in_a", "in_b", "in_c").agg(F.count("*").alias("n"))


@query("missing_reads", "select o_orderkey from orders except select l_orderkey from lineitem where l_returnflag = 'R'")
def missing_reads(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").exceptAll(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()).distinct()


@query("fallback_to_original", "select o_orderkey, coalesce(n, -1) as lines, n is null as missing from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey")
def fallback_to_original(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(-1)).cast("long").alias("lines"), F.col("n").isNull().alias("missing"))


@query(
    "location_overlap",
    """, s as (select qname, ord, rname, start, start + 200 as stop, row_number() over (partition by qname order by ord) as rn from aln)
    select c.qname, c.rname = o.rname and (c.start between o.start and o.stop or c.stop between o.start and o.stop) as same from s c join s o on c.qname = o.qname and o.rn = 1 and c.rn = 2""", (ALIGNMENTS,),
)
def location_overlap(spark, sf_dir):
    rows = alignments(spark, sf_dir).withColumn("stop", F.col("start") + 200).withColumn("rn", F.row_number().over(Window.partitionBy("qname").orderBy("ord")))
    return E.same_region(rows.filter("rn = 1"), rows.filter("rn = 2"))


@query("coverage_unambiguous", "select rname, count(distinct qname) filter (ord % 10 >= 3) as unambiguous, count(distinct qname) filter (ord % 10 < 3) as ambiguous from aln group by rname", (ALIGNMENTS,))
def coverage_unambiguous(spark, sf_dir):
    sure = F.col("ord") % 10 >= 3
    return alignments(spark, sf_dir).groupBy("rname").agg(F.count_distinct(F.when(sure, F.col("qname"))).alias("unambiguous"), F.count_distinct(F.when(~sure, F.col("qname"))).alias("ambiguous"))


@query("overcorrection_histogram", "select least(l_quantity, 16)::int as bin, l_linenumber % 3 as isoforms, count(*) as n from lineitem group by 1, 2")
def overcorrection_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least("l_quantity", F.lit(16.0)).cast("int").alias("bin"), (F.col("l_linenumber") % 3).alias("isoforms")).agg(F.count("*").alias("n"))


@query("overcorrection_rate", "select l_returnflag, round(100.0 * count(*) filter (l_linestatus = 'F' and l_linenumber = 1) / nullif(count(*) filter (l_linenumber = 1), 0), 1)::double as i1, round(100.0 * count(*) filter (l_linestatus = 'F' and l_linenumber = 4) / nullif(count(*) filter (l_linenumber = 4), 0), 1)::double as i4 from lineitem group by 1")
def overcorrection_rate(spark, sf_dir):
    rate = lambda k: F.round(100.0 * F.count_if((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == k)) / F.nullif(F.count_if(F.col("l_linenumber") == k), F.lit(0)), 1)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(rate(1).alias("i1"), rate(4).alias("i4"))


@query("depth_fraction_pivot", "select l_linenumber, round(avg(case when l_linestatus = 'F' then 1 else 0 end) filter (l_returnflag = 'A'), 6) as \"A\", round(avg(case when l_linestatus = 'F' then 1 else 0 end) filter (l_returnflag = 'N'), 6) as \"N\", round(avg(case when l_linestatus = 'F' then 1 else 0 end) filter (l_returnflag = 'R'), 6) as \"R\" from lineitem group by 1")
def depth_fraction_pivot(spark, sf_dir):
    hit = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg(hit), 6))


@query("contingency", "select a.l_linestatus as original, b.l_linestatus as corrected, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2 group by 1, 2")
def contingency(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    a = rows.filter("l_linenumber = 1").select("l_orderkey", F.col("l_linestatus").alias("original"))
    b = rows.filter("l_linenumber = 2").select("l_orderkey", F.col("l_linestatus").alias("corrected"))
    return a.join(b, "l_orderkey").groupBy("original", "corrected").agg(F.count("*").alias("n"))


@query("fixed_histogram", "select floor(l_discount * 100)::int as bin, count(*) as n from lineitem group by 1")
def fixed_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_discount") * 100).cast("int").alias("bin"), ).agg(F.count("*").alias("n"))


@query("grouped_spread", "select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as sd, min(c_acctbal) as least, max(c_acctbal) as most, round(median(c_acctbal), 4) as median from customer group by 1")
def grouped_spread(spark, sf_dir):
    c = "c_acctbal"
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.median(c), 4).alias("median"))


@query("upper_median", "select o_orderpriority, o_totalprice as median from (select *, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as place, count(*) over (partition by o_orderpriority) as n from orders) where place = n // 2")
def upper_median(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority")
    rows = table(spark, sf_dir, "orders").withColumn("at", F.row_number().over(w.orderBy("o_totalprice")) - 1).withColumn("n", F.count("*").over(w))
    return rows.filter(F.col("at") == F.floor(F.col("n") / 2)).select("o_orderpriority", F.col("o_totalprice").alias("median"))


@query("uniform_sample_hash", "select c_custkey from customer order by md5('7' || c_custkey), c_custkey limit 50")
def uniform_sample_hash(spark, sf_dir):
    """A sample of 50 without replacement."""
    return E.sample_by_hash(table(spark, sf_dir, "customer").select("c_custkey"), 50, "c_custkey", "7")


@query("stratified_sample", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by md5('7' || c_custkey), c_custkey) as rn from customer) where rn <= 5")
def stratified_sample(spark, sf_dir):
    return E.sample_by_hash(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), 5, "c_custkey", "7", ["c_nationkey"])


@query("cluster_numbering", "select c_nationkey, count(*) as reads, (row_number() over (order by count(*) desc, c_nationkey) - 1)::int as cluster from customer group by 1 having count(*) >= 3")
def cluster_numbering(spark, sf_dir):
    return E.numbered_clusters(table(spark, sf_dir, "customer"), "c_nationkey")


@query("true_coverage", "select l_orderkey, max(l_linenumber) + 1 as coverage from lineitem group by 1")
def true_coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("coverage"))


@query("keep_old_antijoin", "select o_orderkey, o_custkey from orders where o_custkey not in (select o_custkey from (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as f from orders group by 1) where n = f)")
def keep_old_antijoin(spark, sf_dir):
    """Reads of clusters that aren't finished: finished are those with as many output reads as input reads."""
    from ..sources.sequence_files import unfinished

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cluster_id"), "o_orderstatus")
    return unfinished(rows, rows.filter("o_orderstatus = 'F'")).select("o_orderkey", F.col("cluster_id").alias("o_custkey"))


@query("corrected_region_islands", "select user_id, island, min(p) as first, max(p) as last, count(*) as n from (select user_id, p, sum(j) over (partition by user_id order by p)::bigint as island from (select user_id, p, coalesce((p > lag(p) over (partition by user_id order by p) + 1)::int, 0) as j from (select distinct user_id, event_id // 20 as p from events))) group by 1, 2")
def corrected_region_islands(spark, sf_dir):
    return E.islands(table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 20).alias("p")), "user_id", "p")


@query("running_totals", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as total, max(event_id) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_seen from events")
def running_totals(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"), F.max("event_id").over(w).alias("last_seen"))


@query("run_lengths", "select user_id, event_type, grp, count(*) as run from (select *, sum(b) over (partition by user_id order by ts, event_id)::bigint as grp from (select *, coalesce((event_type <> lag(event_type) over (partition by user_id order by ts, event_id))::int, 0) as b from events)) group by 1, 2, 3")
def run_lengths(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("b", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(0))).withColumn("grp", F.sum("b").over(w))
    return rows.groupBy("user_id", "event_type", "grp").agg(F.count("*").alias("run"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")


@query("header_parse", "select p_partkey, split_part(h, '|', 1) as gene, regexp_replace(split_part(h, '|', 2), '_[^_]*$', '') as transcript, split_part(split_part(h, '|', 2), '_', -1) as ordinal from (select p_partkey, p_brand || '|' || replace(p_type, ' ', '.') || '_' || p_size as h from part)")
def header_parse(spark, sf_dir):
    h = F.concat("p_brand", F.lit("|"), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit("_"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("h")).select("p_partkey", *header_parts(F.col("h")))


@query("mappability_bins", "select case when p_size > 0 and p_size <= 10 then '(0,10]' when p_size > 10 and p_size <= 25 then '(10,25]' when p_size > 25 and p_size <= 50 then '(25,50]' end as bin, count(*) as n, round(avg(p_retailprice), 4) as mean from part group by 1")
def mappability_bins(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(right_closed_bin(F.col("p_size"), [0, 10, 25, 50]).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("lookup_with_fallback", "select s_suppkey, coalesce(n_name, 'unknown') as nation, coalesce(r_name, 'unknown') as region from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def lookup_with_fallback(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("union_experiments", "select 'labels' as experiment, doc_id as id, toxic::bigint as value from labels union all select 'embeddings', vec_id, label from embeddings union all select 'turns', conv_id, turn from conversations")
def union_experiments(spark, sf_dir):
    parts = [("labels", "doc_id", "toxic"), ("embeddings", "vec_id", "label"), ("conversations", "conv_id", "turn")]
    out = None
    for name, key, value in parts:
        part = table(spark, sf_dir, name).select(F.lit("turns" if name == "conversations" else name).alias("experiment"), F.col(key).alias("id"), F.col(value).cast("long").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("array_positions", "select vec_id, len(embedding) - list_position(list_reverse(embedding), list_max(embedding)) + 1 as at from embeddings")
def array_positions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", last_position(F.col("embedding"), F.array_max("embedding")).cast("long").alias("at"))


@query("substring_either_way", "select n_nationkey, r_regionkey from nation join region on n_regionkey = r_regionkey where contains(n_name, r_name) or contains(r_name, n_name) or contains(n_name, substring(r_name, 1, 1))")
def substring_either_way(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    either = contains_either(F.col("n_name"), F.col("r_name")) | F.contains("n_name", F.substring("r_name", 1, 1))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter(either).select("n_nationkey", "r_regionkey")


@query("switched_to_minor", "select doc_id, case when (quality = 1) = (toxic = 1) then 1 else 0 end as minor from labels")
def switched_to_minor(spark, sf_dir):
    same = (F.col("quality") == 1) == (F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").select("doc_id", F.when(same, 1).otherwise(0).alias("minor"))


@query("symmetric_header_check", "select count(*) filter (where b.o_custkey is null) as only_customers, count(*) filter (where c_custkey is null) as only_orders from customer full join (select distinct o_custkey from orders) b on c_custkey = o_custkey")
def symmetric_header_check(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey").distinct()
    both = c.join(o, c["c_custkey"] == o["o_custkey"], "full")
    return both.agg(F.count_if(F.col("o_custkey").isNull()).alias("only_customers"), F.count_if(F.col("c_custkey").isNull()).alias("only_orders"))
