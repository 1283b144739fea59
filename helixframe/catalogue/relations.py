"""Queries over range-read files, committed cluster files, and steps of the correction as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, relations, seeds
from ..plans.params import Params
from ..session import cut, scratch
from ..sources import cluster_files, ranges
from .reads import MINS, PAIRS, WINDOWS
from .registry import BENCH, READS, TWINS, bench_reads, query, read_table, twins

P = Params()
RATIO = 0.1
QUALITY = "".join(chr(33 + 5 + (i * 7) % 30) for i in range(30)).replace("'", "''")
WHOLE = f"substring(repeat('{QUALITY}', (length(seq) / 30 + 1)::int), 1, length(seq))"


@query("cluster_files", f"select cluster_id, r_id, acc, seq, {WHOLE} as qual from reads", (READS,))
def cluster_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of every document written as one FASTQ file for each cluster, and read back in byte ranges."""
    folder = scratch(spark, "clusters")
    cluster_files.write_clusters(read_table(spark, sf_dir), folder)
    back = ranges.read_records(spark, f"{folder}/*/{cluster_files.FILE}", range_bytes=1 << 18)
    return back.select(F.regexp_extract("path", rf"([^/]+)/{cluster_files.FILE}$", 1).alias("cluster_id"), "r_id", "acc", "seq", "qual")


@query("cluster_files_by_name", """select cluster_id, acc, row_number() over (partition by cluster_id order by ((r_id - 1) // 20)::varchar, r_id)::int as place from reads""", (READS,))
def cluster_files_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every read in its cluster's file where batches of 20 follow each other by name, read back as four-line records."""
    folder = scratch(spark, "clusters")
    cluster_files.write_clusters(read_table(spark, sf_dir), folder, by_name=20)
    back = ranges.read_records4(spark, f"{folder}/*/{cluster_files.FILE}", range_bytes=1 << 18)
    return back.select(F.regexp_extract("path", rf"([^/]+)/{cluster_files.FILE}$", 1).alias("cluster_id"), "acc", F.col("r_id").alias("place"))


@query("sequence_ranges", f"select acc, seq, case when r_id % 2 = 0 and seq <> '' then {WHOLE} end as qual from reads", (READS,))
def sequence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of every document as files of FASTA and FASTQ records over many lines, some of which end in \\r\\n, read in byte ranges."""
    folder = scratch(spark, "sequences")
    wrapped = lambda c: F.regexp_replace(c, "(.{70})", "$1\n")
    fasta = F.concat(F.lit(">"), "acc", F.lit("\r\n"), wrapped(F.col("seq")))
    fastq = F.concat(F.lit("@"), "acc", F.lit("\n"), wrapped(F.col("seq")), F.lit("\n+\n"), wrapped(F.col("qual")))
    reads = read_table(spark, sf_dir)
    rows = reads.select("cluster_id", "acc", F.when((F.col("r_id") % 2 == 0) & (F.col("seq") != ""), fastq).otherwise(fasta).alias("value"))
    # A cluster's records are written by many tasks, each to a file of its own, whose ranges prove one another by themselves.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows.withColumn("piece", F.pmod(F.xxhash64("acc"), F.lit(n))).repartition(n, "cluster_id", "piece").drop("piece", "acc").write.partitionBy("cluster_id").text(folder)
    return ranges.read_records(spark, f"{folder}/*/*.txt", range_bytes=1 << 18).select("acc", "seq", "qual")


TWIN_MINS = MINS.replace("cluster_id, ", "").replace("r_id", "item_id").replace("from reads", "from twins")
TWIN_PAIRS = PAIRS.replace("pairs as", "bp as").replace("a.cluster_id, ", "").replace("a.cluster_id = b.cluster_id and ", "").replace("r_id", "item_id")


def _twin_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reads and their anchor pairs: every benchmark sequence with its two variants, in one cluster."""
    reads = twins(spark, sf_dir).select(F.lit("all").alias("cluster_id"), F.col("item_id").cast("int").alias("r_id"), "seq", F.lit(None).cast("string").alias("qual"))
    mins = F.transform(seeds.window_minimizer_array(F.col("seq"), P.k, P.w), lambda m: F.struct(m["kmer"].alias("kmer"), (-m["neg"]).alias("pos")))
    return reads, cut(seeds.exploded_pairs(reads.select("cluster_id", "r_id", mins.alias("minimizers")), P.low, P.xmax, P.k), "pairs")


def _spans(pairs: DataFrame) -> DataFrame:
    """Every so many pairs as corrected already."""
    return pairs.filter((F.col("p1") + F.col("p2") + F.col("r_id")) % 23 == 0).select("cluster_id", "r_id", (F.col("p1") + P.k).alias("start"), F.col("p2").alias("stop"))


@query(
    "open_anchors",
    """, spans as (select item_id, p1 + 9 as start, p2 as stop from bp where (p1 + p2 + item_id) % 23 = 0),
    cov as (select distinct item_id, unnest(range(start, stop)) as pos from spans),
    isl as (select item_id, pos, pos - row_number() over (partition by item_id order by pos) as run from cov)
    select p.item_id::int as r_id, p1, p2, m1, m2, (a.run is not null and b.run is not null)::int as across from bp p
    left join isl a on a.item_id = p.item_id and a.pos = p1 + 9 left join isl b on b.item_id = p.item_id and b.pos = p2 - 1
    where a.run is null or b.run is null or a.run <> b.run""",
    (BENCH, TWINS, TWIN_MINS, TWIN_PAIRS),
)
def open_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors outside what is corrected already, and those across a gap between two corrected runs."""
    _, pairs = _twin_pairs(spark, sf_dir)
    return relations.open_anchors(pairs, _spans(pairs), P.k).select("r_id", "p1", "p2", "m1", "m2", "across")


@query("support_exact")
def support_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of every other read for each open anchor, with what was measured for the anchors before."""
    reads, pairs = _twin_pairs(spark, sf_dir)
    counts = pairs.groupBy("cluster_id", "m1", "m2").agg(F.count("*").alias("occurrences"))
    kept = seeds.kept_anchors(counts, reads.groupBy("cluster_id").agg(F.count("*").alias("n_reads")), P.k)
    return relations.support_exact(reads, pairs, kept, relations.open_anchors(pairs, _spans(pairs), P.k), P.k)


#: Sixteen readers of one alignment for each benchmark sequence: a base that seven have otherwise, one that eight lack, one that
#: nine have more, and noise.
MIXED = """mixed as (
  select item_id, r_id, row, consensus, r_id * 3 as q1, (r_id * 3 + length(replace(row, '-', '')) - 9)::int as q2 from (
  select item_id, r_id, substring(seq, 1, 20) || case when r_id <= 7 then translate(substring(seq, 21, 1), 'ACGT', 'CGTA') else substring(seq, 21, 1) end || substring(seq, 22, 19)
    || case when r_id <= 2 then substring('ACGT', (r_id + item_id)::int % 4 + 1, 1) else substring(seq, 41, 1) end || substring(seq, 42, 9) || case when r_id <= 9 then 'G' else '-' end
    || substring(seq, 51, 4) || case when r_id = 3 then '-' else substring(seq, 55, 1) end || substring(seq, 56, 14) || case when r_id between 5 and 12 then '-' else substring(seq, 70, 1) end || substring(seq, 71) as row,
    substring(seq, 1, 50) || '-' || substring(seq, 51) as consensus from (select item_id, seq, unnest(range(1, 17))::int as r_id from bench where length(seq) >= 90)))"""


def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, r_id, row, consensus, q1, q2 as MIXED has them."""
    rows = bench_reads(spark, sf_dir).filter("length(seq) >= 90").select("item_id", "seq", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("r_id"))
    part = lambda at, n: F.substring("seq", at, n)
    pick = lambda cond, a, b: F.when(F.expr(cond), a).otherwise(b)
    gap = F.lit("-")
    row = F.concat(
        part(1, 20), pick("r_id <= 7", F.translate(part(21, 1), "ACGT", "CGTA"), part(21, 1)), part(22, 19), pick("r_id <= 2", F.expr("substring('ACGT', cast((r_id + item_id) % 4 as int) + 1, 1)"), part(41, 1)),
        part(42, 9), pick("r_id <= 9", F.lit("G"), gap), part(51, 4), pick("r_id = 3", gap, part(55, 1)), part(56, 14), pick("r_id between 5 and 12", gap, part(70, 1)), F.expr("substring(seq, 71)"),
    )
    made = rows.select("item_id", "r_id", row.alias("row"), F.concat(part(1, 50), gap, F.expr("substring(seq, 51)")).alias("consensus"))
    return made.withColumn("q1", F.col("r_id") * 3).withColumn("q2", F.col("q1") + F.length(columns.bare(F.col("row"))) - P.k)


MIXED_CENTERS = "gapped as (select distinct item_id, consensus as g from mixed)"
#: Contexts that are no noise, and what stands beside the consensus: a fold over them, one a step.
BESIDE = """lim as (select item_id, greatest(3.0, count(*) * 0.1)::double as threshold from mixed group by 1),
ctx as (
  select *, row_number() over (partition by item_id, col order by depth desc, context) as rank from (
    select item_id, col, substring(row, col + 1, 1) as variant, substring(row, start + 1, stop - start) as context, count(*) as depth
    from (select item_id, row from mixed union all select item_id, g from gapped) join wins using (item_id) group by 1, 2, 3, 4) join lim using (item_id) where depth > greatest(threshold / 10, 5)),
open as (
  select c.item_id, c.col, threshold, replace(substring(g, start + 1, stop - start), '-', '') as plain from (select item_id, col from ctx group by 1, 2 having count(distinct variant) > 1) c
  join wins using (item_id, col) join gapped using (item_id) join lim using (item_id)),
fold as (
  select item_id, col, threshold, 0::bigint as step, plain, p as short, [{'form': p, 'v': null::varchar, 'c': null::varchar, 'd': null::bigint}] || case when p = plain then [] else [{'form': plain, 'v': null::varchar, 'c': null::varchar, 'd': null::bigint}] end as filed
  from (select *, array_to_string(list_filter(string_split(plain, ''), lambda c, i: i = 1 or c <> substring(plain, i - 1, 1)), '') as p from open)
  union all
  select item_id, col, threshold, step + 1, plain, short, case
      when len(list_filter(filed, lambda f: f.form = brief)) > 0 or depth < threshold / greatest(1.0, near.d) then filed
      when len(list_filter(filed, lambda f: f.form = near.form)) > 0 then list_transform(filed, lambda f: case when f.form = near.form then {'form': f.form, 'v': variant, 'c': context, 'd': depth} else f end)
      else filed || [{'form': near.form, 'v': variant, 'c': context, 'd': depth}] end
  from (
    select *, list_sort(list_transform(filed, lambda f, i: {'d': levenshtein(f.form, bare), 'at': i * 2, 'form': bare}) || list_transform(filed, lambda f, i: {'d': levenshtein(f.form, brief), 'at': i * 2 + 1, 'form': brief}))[1] as near
    from (
      select *, array_to_string(list_filter(string_split(bare, ''), lambda c, i: i = 1 or c <> substring(bare, i - 1, 1)), '') as brief
      from (select f.*, x.variant, x.context, x.depth, replace(x.context, '-', '') as bare from fold f join ctx x on x.item_id = f.item_id and x.col = f.col and x.rank = f.step + 1)))),
beside as (
  select item_id, col, alts from (
    select item_id, col, list_filter(filed, lambda f: f.form <> plain and f.form <> short) as alts from (
      select item_id, col, arg_max(filed, step) as filed, any_value(plain) as plain, any_value(short) as short from fold group by 1, 2)) where len(alts) > 0)"""
MIXED_TABLES = ("recursive " + BENCH, MIXED, MIXED_CENTERS, WINDOWS, BESIDE)


def _beside(rows: DataFrame) -> DataFrame:
    centers = rows.select("item_id", "consensus").distinct()
    wins, limits = columns.windows(centers, P.k), columns.thresholds(rows, RATIO)
    return columns.alternatives(columns.contexts(rows, wins, limits), centers, wins, limits)


@query("alternative_contexts", "select item_id, col, unnest(range(1, len(alts) + 1)) as place, unnest(alts).v as variant, unnest(alts).c as context, unnest(alts).d as depth from beside", MIXED_TABLES)
def alternative_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that stand beside the consensus at each column, in order of filing."""
    found = _beside(mixed_rows(spark, sf_dir)).select("item_id", "col", F.posexplode("alternatives").alias("place", "x"))
    return found.select("item_id", "col", (F.col("place") + 1).cast("long").alias("place"), "x.variant", "x.context", "x.depth")


CORRECTED = """own as (
  select m.item_id, m.r_id, w.col, substring(row, col + 1, 1) as own, substring(consensus, col + 1, 1) as ref, substring(row, start + 1, stop - start) as context, substring(consensus, start + 1, stop - start) as center,
    substring(row, start + 1, col - start) = substring(consensus, start + 1, col - start) and substring(row, col + 2, stop - col - 1) = substring(consensus, col + 2, stop - col - 1) as same
  from mixed m join wins w using (item_id)),
deep as (select *, count(*) over (partition by item_id, col, own) as depth from own),
bases as (
  select item_id, r_id, col, ref, case
    when own = ref then ref
    when alts is null then case when own <> '-' and ref <> '-' and depth >= threshold and same then own else ref end
    when len(list_filter(alts, lambda x: x.c = context)) > 0 then list_filter(alts, lambda x: x.c = context)[1].v
    else list_sort([{'d': levenshtein(replace(center, '-', ''), replace(context, '-', '')), 'n': 0, 'v': ref}] || list_transform(alts, lambda x, i: {'d': levenshtein(replace(x.c, '-', ''), replace(context, '-', '')), 'n': i, 'v': x.v}))[1].v end as base
  from deep join lim using (item_id) left join beside using (item_id, col)),
done as (select item_id, r_id, string_agg(base, '' order by col) filter (base <> '-') as corrected from bases group by 1, 2)"""


@query("correct_columns_with_alternatives", "select item_id, r_id, corrected from done", (*MIXED_TABLES, CORRECTED))
def correct_columns_with_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader's corrected text where other contexts than the consensus's are admitted."""
    return columns.corrected(mixed_rows(spark, sf_dir), P.k, RATIO)


@query("corrected_spans", f"select m.item_id, m.r_id, q1 + 9 as start, q2 as stop, count(*) over (partition by m.item_id) as weight, substring(corrected, 10, greatest(length(corrected) - {2 * P.k}, 0)::int) as text from mixed m join done using (item_id, r_id)", (*MIXED_TABLES, CORRECTED))
def corrected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every reader of an interval is corrected to, its anchors cut off."""
    return columns.corrected_spans(mixed_rows(spark, sf_dir), P.k, RATIO)


@query(
    "anchor_chain_groups",
    """, often as (select m1, m2, count(*)::int as support from bp group by 1, 2 having count(*) >= 3),
    iv1 as (
      select item_id, m1, m2, p1 + 9 as start, p2 as stop, row_number() over (partition by item_id order by p2, p1)::int as j, (support - 1) * (p2 - p1 - 9 + 0.0001::double) as w from bp join often using (m1, m2)),
    iv as (select a.*, coalesce((select max(b.j) from iv1 b where b.item_id = a.item_id and b.stop <= a.start), 0)::int as pre from iv1 a),
    last as (select item_id, max(j) as n from iv group by 1),
    opt as (
      select item_id, 0 as j, [0.0::double] as best from last
      union all select o.item_id, i.j, list_append(o.best, greatest(i.w + o.best[i.pre + 1], o.best[i.j])) from opt o join iv i on i.item_id = o.item_id and i.j = o.j + 1),
    walk as (
      select o.item_id, o.j, o.best from opt o join last l on l.item_id = o.item_id and l.n = o.j
      union all select x.item_id, case when i.w + x.best[i.pre + 1] > x.best[i.j] then i.pre else i.j - 1 end, x.best from walk x join iv i on i.item_id = x.item_id and i.j = x.j),
    chains as (
      select i.item_id, count(*)::int as anchors, string_agg(m1 || '-' || m2, ',' order by stop) as chain from walk x join iv i on i.item_id = x.item_id and i.j = x.j where i.w + x.best[i.pre + 1] > x.best[i.j] group by 1)
    select item_id::int as r_id, anchors, (min(item_id) over (partition by chain))::int as first, count(*) over (partition by chain) as reads from chains""",
    ("recursive " + BENCH, TWINS, TWIN_MINS, TWIN_PAIRS),
)
def anchor_chain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose best chain of anchors that three places share is the same."""
    from ..operators.udfs import schedule_by

    _, pairs = _twin_pairs(spark, sf_dir)
    often = pairs.groupBy("cluster_id", "m1", "m2").agg(F.count("*").cast("int").alias("support")).filter("support >= 3")
    spans = pairs.join(often, ["cluster_id", "m1", "m2"]).select("cluster_id", "r_id", "m1", "m2", (F.col("p1") + P.k).alias("start"), F.col("p2").alias("stop"), "support")
    chosen = schedule_by(spans, "r_id").join(spans, ["r_id", "start", "stop", "support"])
    return relations.anchor_chains(chosen.select("cluster_id", "r_id", F.col("stop").alias("place"), "m1", "m2")).select("r_id", "anchors", "first", "reads")
