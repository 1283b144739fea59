"""Queries whose columns are those of published result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import published
from ..session import table
from .assessment import PERTURBED, SIDES, _perturbed
from .registry import ALIGNMENTS, BENCH, alignments, bench_reads, query

#: Reads named family|gene|transcript_n; the corrected form of a read is the next of its variants.
NAMED = """named as (
  select c.item_id, 'f' || (c.item_id % 5) || '|g' || (c.item_id % 20) || '|' || c.item_id || '_' || c.v as acc, c.seq as original, n.seq as corrected, t.seq as truth
  from corrected c join corrected n on n.item_id = c.item_id and n.v = (c.v + 1) % 4 join corrected t on t.item_id = c.item_id and t.v = 0),
forms as (select item_id, acc, 'corrected' as type, corrected as seq, truth from named union all select item_id, acc, 'original', original, truth from named),
sized as (select *, levenshtein(seq, truth)::int as err, length(seq) - length(truth) as longer, length(seq) as n, length(truth) as read_length from forms)"""


def _acc() -> Column:
    return F.concat(F.lit("f"), F.col("item_id") % 5, F.lit("|g"), F.col("item_id") % 20, F.lit("|"), F.col("item_id"), F.lit("_"), F.col("v"))


@query(
    "published_error_profile",
    """select acc as read, read_length::int as read_length, err, greatest(longer, 0)::int as ins, greatest(-longer, 0)::int as del, (err - abs(longer))::int as subs, (n - greatest(longer, 0) - err + abs(longer))::int as matches,
      round(100 * err / (read_length + greatest(longer, 0))::double, 2) as err_rate, type, t.c as transcript_cov, g.c as gene_cov, f.c as gene_fam_cov
    from sized s join (select item_id, count(*) as c from named group by 1) t using (item_id) join (select item_id % 20 as g, count(*) as c from named group by 1) g on g.g = item_id % 20
    join (select item_id % 5 as f, count(*) as c from named group by 1) f on f.f = item_id % 5""",
    (BENCH, PERTURBED, NAMED),
)
def published_error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of corrected and original reads with transcript, gene and family coverage. At most two edits of known kinds, so SQL can tell them from lengths."""
    reads, _ = _perturbed(spark, sf_dir)
    rows = reads.select("item_id", "v", "seq")
    corrected = rows.select("item_id", ((F.col("v") + 3) % 4).alias("v"), "seq")
    true = rows.filter("v = 0").select(F.col("item_id").cast("string").alias("transcript"), "seq")
    return published.error_profile(corrected.select(_acc().alias("acc"), "seq"), rows.select(_acc().alias("acc"), "seq"), true)


PERTURBED_NAMES = """exps as (
  select (item_id % 3)::int as id, 'snp' as type, (10 * (item_id % 3 + 1))::int as Depth, 0.1 * (item_id % 3 + 1) as p, 'f|' || case when v % 2 = 1 then 'minor' else 'major' end || '|t' || case when v % 2 = 1 then item_id + 1000000 else item_id end || '_' || v as acc, seq from corrected),
named_refs as (select 't' || ref as ref_acc, seq from refs)"""


@query(
    "published_perturbation",
    """, d as (select id, acc, ref_acc, levenshtein(c.seq, r.seq)::int as ed, length(r.seq) as n, row_number() over (partition by id, acc order by levenshtein(c.seq, r.seq), ref_acc) as rn from exps c join named_refs r on levenshtein(c.seq, r.seq) < 1000),
    ab as (select id, split_part(acc, '_', 1) as origin, count(*) as abundance from exps group by 1, 2)
    select e.id, type, Depth, round(p, 6) as p, e.acc as q_acc, ref_acc as r_acc, ed as total_errors, round(100 * ed / n::double, 4) as error_rate, abundance, (split_part(origin, '|', 3) = ref_acc)::int as preserved, contains(origin, 'minor')::int as minor
    from d join exps e using (id, acc) join ab on ab.id = e.id and ab.origin = split_part(e.acc, '_', 1) where rn = 1""",
    (BENCH, PERTURBED, PERTURBED_NAMES),
)
def published_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read of three experiments with its nearest reference."""
    reads, refs = _perturbed(spark, sf_dir)
    run = (F.col("item_id") % 3).cast("int")
    odd = F.col("v") % 2 == 1
    acc = F.concat(F.lit("f|"), F.when(odd, "minor").otherwise("major"), F.lit("|t"), F.when(odd, F.col("item_id") + 1000000).otherwise(F.col("item_id")), F.lit("_"), F.col("v"))
    rows = reads.select(run.alias("id"), F.lit("snp").alias("type"), (10 * (run + 1)).alias("Depth"), F.round(F.lit(0.1) * (run + 1), 6).alias("p"), acc.alias("acc"), "seq")
    return published.perturbation(rows, refs.select(F.concat(F.lit("t"), "ref").alias("ref_acc"), "seq"))


@query(
    "published_location_stability",
    """select (o_custkey % 50)::int as nr_reads, [1, 4, 8][o_orderkey % 3 + 1]::int as nr_isoforms, (not list_has_any([(o_orderkey % 7), (o_orderkey % 3)], [(o_custkey % 5), (o_custkey % 4)]))::int as is_overcorrected from orders where o_orderkey % 11 <> 5""",
)
def published_location_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads, named by depth and isoforms, with two references before and two after; some are lost."""
    orders = table(spark, sf_dir, "orders")
    isoforms = F.get(F.array(F.lit(1), F.lit(4), F.lit(8)), (F.col("o_orderkey") % 3).cast("int"))
    acc = F.concat_ws(",", F.col("o_orderkey"), F.col("o_custkey") % 50, isoforms)
    original = orders.select(acc.alias("acc"), F.concat_ws(":", F.col("o_orderkey") % 7, F.col("o_orderkey") % 3).alias("chr_id"))
    corrected = orders.filter("o_orderkey % 11 <> 5").select(acc.alias("acc"), F.concat_ws(":", F.col("o_custkey") % 5, F.col("o_custkey") % 4).alias("chr_id"))
    return published.location_stability(original, corrected)


@query("published_aligned_coverage", "select rname as transcript, case when ord % 30 >= 10 then 'unambiguous' else 'ambiguous' end as type, count(distinct qname) as depth from aln where ord % 4 < 3 group by 1, 2", (ALIGNMENTS,))
def published_aligned_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of every reference by the quality of their primary alignments."""
    flag = F.when(F.col("ord") % 4 == 0, 16).when(F.col("ord") % 4 < 3, 0).otherwise(256)
    rows = alignments(spark, sf_dir).select("qname", "rname", flag.alias("flag"), (F.col("ord") % 30).cast("int").alias("mapq"))
    return published.aligned_coverage(rows)


#: First alignments of original and corrected reads, with errors and lengths from their CIGARs.
SCORED = r"""both_sets as (select 'original' as set, qname as read, ord, cigar from oaln union all select 'corrected', qname, ord, cigar from caln),
one as (select * from (select *, row_number() over (partition by set, read order by ord) as rn from both_sets) where rn = 1),
scored as (
  select set, read, list_sum([x::int for x in regexp_extract_all(cigar, '(\d+)[XID]', 1)])::double as nm, list_sum([x::int for x in regexp_extract_all(cigar, '(\d+)[M=XI]', 1)])::double as aligned,
    list_sum([x::int for x in regexp_extract_all(cigar, '(\d+)[M=XISH]', 1)])::double as read_len from one),
usable as (select *, 100 * nm / aligned as e, 100 * aligned / read_len as a from scored where read in (select read from scored group by 1 having count(*) = 2)),
ranked as (select *, row_number() over (partition by set order by e) - 1 as nth, count(*) over (partition by set) as n from usable)"""


def _set_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the evaluation in one pass: line items are dealt by read once, and all that follows keeps to that."""
    flag = F.when(F.col("ord") % 4 == 0, 16).otherwise(0)
    sides = F.array(F.when(F.expr("rname < 6"), F.lit("original")), F.when(F.expr("ord % 10 < 7 and qname % 11 <> 5"), F.lit("corrected")))
    rows = alignments(spark, sf_dir, together=True).select(F.explode_outer(sides).alias("set"), F.col("qname").alias("read"), "ord", flag.alias("flag"), "cigar")
    return rows.filter("set is not null")


@query(
    "genome_accuracy",
    """select set, count(*) as n, round(avg(e), 6) as err_mean, round(median(e), 6) as err_median, round(max(e) filter (nth = least(n - 1, floor(n * 0.9))), 6) as err_p90,
      round(avg(a), 6) as aln_mean, round(median(a), 6) as aln_median, round(100 * sum(nm) / sum(aligned), 6) as err_total from ranked group by 1""",
    (ALIGNMENTS, SIDES, SCORED),
)
def genome_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and aligned percentages of original and corrected reads against a genome."""
    return published.genome_accuracy(_set_alignments(spark, sf_dir), 2)


@query(
    "genome_accuracy_paired",
    """select 'corrected' as set, round(avg(c.e - o.e), 6) as mean_delta, count(*) filter (c.e < o.e) as better, count(*) filter (c.e > o.e) as worse, count(*) filter (c.e = o.e) as equal
    from usable c join usable o using (read) where c.set = 'corrected' and o.set = 'original'""",
    (ALIGNMENTS, SIDES, SCORED),
)
def genome_accuracy_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected reads against original ones, read by read."""
    return published.paired_accuracy(_set_alignments(spark, sf_dir), "original", 2)


@query(
    "mappability_error_bins",
    """, k as (select item_id, substring(seq, p + 1, 15) as kmer from (select item_id, seq, unnest(range(greatest(length(seq) - 14, 0))) as p from bench)),
    kc as (select kmer, count(*) as n from k group by 1), mult as (select item_id, avg(n) as multiplicity from k join kc using (kmer) group by 1),
    e as (select c.item_id, 100 * levenshtein(c.seq, t.seq) / length(t.seq)::double as error from corrected c join corrected t on t.item_id = c.item_id and t.v = 0 where c.v > 0),
    b as (select error, case when multiplicity > 0 and multiplicity <= 1 then '(0,1]' when multiplicity > 1 and multiplicity <= 2 then '(1,2]' when multiplicity > 2 and multiplicity <= 100 then '(2,100]' end as bin from e join mult using (item_id))
    select bin, count(*) as n, round(quantile_cont(error, 0.25), 6) as q1, round(median(error), 6) as median, round(quantile_cont(error, 0.75), 6) as q3 from b group by 1""",
    (BENCH, PERTURBED),
)
def mappability_error_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the errors of reads by how often the 15-mers of their sequence occur in all sequences."""
    reads, _ = _perturbed(spark, sf_dir)
    k = bench_reads(spark, sf_dir).select("item_id", F.explode(S.kmers(F.col("seq"), 15)).alias("s")).select("item_id", "s.kmer")
    mult = k.join(k.groupBy("kmer").agg(F.count("*").alias("n")), "kmer").groupBy("item_id").agg(F.avg("n").alias("multiplicity"))
    true = reads.filter("v = 0").select("item_id", F.col("seq").alias("true"))
    rows = reads.filter("v > 0").join(true, "item_id").join(mult, "item_id").select((100 * F.levenshtein("seq", "true") / F.length("true")).alias("error"), S.right_closed_bin(F.col("multiplicity"), [0, 1, 2, 100]).alias("bin"))
    q = lambda p: F.round(F.percentile("error", F.lit(p)), 6)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
