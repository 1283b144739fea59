"""Where queries register, and the adapters that turn the driver's tables into reads, alignments and annotation.

Each adapter exists twice: as DataFrame code here, and as common table expressions for the SQL twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import ALPHABET, BASES, bases_of, cyclic_quality, reads_of
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SEQ = f"translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}')"
_PATTERN = "".join(chr(33 + 5 + (i * 7) % 30) for i in range(30)).replace("'", "''")
READS = f"""reads as (
  select lang as cluster_id, (row_number() over (partition by lang order by doc_id))::int as r_id, 'doc_' || doc_id as acc, {_SEQ} as seq from documents)"""
BENCH = f"""bench as (
  select item_id, {_SEQ} as seq, substring(repeat('{_PATTERN}', (length({_SEQ}) / 30 + 1)::int), 1, length({_SEQ})) as qual from benchmark)"""
ALIGNMENTS = """aln as (
  select qname, ord, min(rname) as rname, min(start) as start, min(cigar) as cigar from (
  select l_orderkey as qname, (l_linenumber * 1000000 + l_partkey % 1000000) as ord, (l_suppkey % 7)::int as rname, (l_partkey * 10)::int as start,
    l_quantity::int || '=' || (l_linenumber + 1) || 'X' || (l_partkey % 4 + 1) || 'I' || (40 + l_linenumber) || '=' || (l_suppkey % 23 + 1) || 'D'
    || (30 + l_quantity::int) || '=' || case when l_linenumber % 2 = 0 then (50 + l_linenumber * 10) || 'N' || l_quantity::int || '=' else '' end as cigar
  from lineitem) group by qname, ord)"""
ANNOTATION = """exons as (
  select (l_suppkey % 7)::int as chrom, l_orderkey // 3 as tx, min(l_partkey * 10)::int as exon_start, (min(l_partkey * 10) + 9)::int as exon_end
  from lineitem group by l_suppkey % 7, l_orderkey // 3, l_linenumber)"""


def query(name: str, oracle: str | None = None, ctes: tuple[str, ...] = ()):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = (f"with {', '.join(ctes)} " if ctes else "") + oracle
        return f

    return register


def read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(table(spark, sf_dir, "documents"))


def spread_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads dealt evenly by their key: ranking leaves a cluster in one task, and array work on its reads comes next.

    The number is given, so that few bytes of long reads aren't drawn together again.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return read_table(spark, sf_dir).repartition(n, "cluster_id", "r_id")


def unranked_reads(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """cluster_id and seq of the reads, dealt evenly, for what doesn't ask for a read's rank: no ranking, no join. numbered: r_id is the document's number."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("cluster_id"), "text").repartition(n, "doc_id")
    return rows.select("cluster_id", (F.col("doc_id") if numbered else F.lit(0)).alias("r_id"), bases_of(F.col("text")).alias("seq"))


def bench_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as the reads of one cluster."""
    seq = bases_of(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", seq.alias("seq"), cyclic_quality(F.length(seq)).alias("qual"))


def alignments(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Line items as alignments: an order is a read, a supplier's residue the reference, quantities the CIGAR. together: dealt by read before all else."""
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    intron = F.when(n % 2 == 0, F.concat((n * 10 + 50).cast("string"), F.lit("N"), q, F.lit("="))).otherwise("")
    cigar = F.concat(q, F.lit("="), n + 1, F.lit("X"), F.col("l_partkey") % 4 + 1, F.lit("I"), n + 40, F.lit("="), F.col("l_suppkey") % 23 + 1, F.lit("D"), q + 30, F.lit("="), intron)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = items.repartition("l_orderkey") if together else items  # before the texts are made, and the same for every use
    rows = items.select(
        F.col("l_orderkey").alias("qname"), (n.cast("long") * 1000000 + F.col("l_partkey") % 1000000).alias("ord"), (F.col("l_suppkey") % 7).cast("int").alias("rname"),
        (F.col("l_partkey") * 10).cast("int").alias("start"), cigar.alias("cigar"),
    )
    return rows.groupBy("qname", "ord").agg(*[F.min(c).alias(c) for c in ("rname", "start", "cigar")])


TWINS = """twins as (
  select item_id * 4 as item_id, seq from bench union all select item_id * 4 + 1, substring(seq, 1, 39) || substring(seq, 41) from bench
  union all select item_id * 4 + 2, substring(seq, 1, 59) || 'A' || substring(seq, 61) from bench)"""
FRAGMENTS = """frags as (
  select item_id, seq from bench union all select item_id + 1000000, substring(seq, 11, 40) from bench where item_id % 2 = 1
  union all select item_id + 2000000, translate(reverse(substring(seq, 21, 50)), 'ACGT', 'TGCA') from bench where item_id % 3 = 0 union all select item_id + 3000000, substring(seq, 1, 5) from bench where item_id % 5 = 0)"""
#: Twelve rows of one alignment for each benchmark sequence, and their consensus row, which holds a gap.
MATRIX = """matrix as (
  select item_id, r_id, substring(seq, 1, 20) || substring('ACGT', r_id % 4 + 1, 1) || substring(seq, 22, 19) || case when r_id <= 2 then substring('ACGT', (r_id + item_id)::int % 4 + 1, 1) else substring(seq, 41, 1) end
    || substring(seq, 42, 9) || case when r_id <= 5 then 'G' else '-' end || substring(seq, 51, 4) || case when r_id = 3 then '-' else substring(seq, 55, 1) end || substring(seq, 56) as row,
    substring(seq, 1, 50) || '-' || substring(seq, 51) as consensus from (select item_id, seq, unnest(range(1, 13))::int as r_id from bench))"""


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark sequence, once as it is, once without a base and once with another one."""
    seq = F.col("seq")
    forms = [seq, F.concat(F.substring(seq, 1, 39), F.expr("substring(seq, 41)")), F.concat(F.substring(seq, 1, 59), F.lit("A"), F.expr("substring(seq, 61)"))]
    rows = bench_reads(spark, sf_dir).select("item_id", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), f.alias("seq")) for i, f in enumerate(forms)])).alias("f"))
    return rows.select((F.col("item_id") * 4 + F.col("f.n")).alias("item_id"), "f.seq")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sequences with parts of some, as they are and as reverse complements."""
    rows = bench_reads(spark, sf_dir).select("item_id", "seq")
    part = lambda n, every, rest, text: rows.filter(F.col("item_id") % every == rest).select((F.col("item_id") + n).alias("item_id"), text.alias("seq"))
    back = F.translate(F.reverse(F.substring("seq", 21, 50)), "ACGT", "TGCA")
    return rows.unionByName(part(1000000, 2, 1, F.substring("seq", 11, 40))).unionByName(part(2000000, 3, 0, back)).unionByName(part(3000000, 5, 0, F.substring("seq", 1, 5)))


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, r_id, row, consensus: twelve rows of an alignment for each benchmark sequence."""
    rows = bench_reads(spark, sf_dir).select("item_id", "seq", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("r_id"))
    base = lambda n: F.expr(f"substring('ACGT', cast(({n}) % 4 as int) + 1, 1)")
    pick = lambda cond, a, b: F.when(F.expr(cond), a).otherwise(b)
    part = lambda at, n: F.substring("seq", at, n)
    row = F.concat(part(1, 20), base("r_id"), part(22, 19), pick("r_id <= 2", base("r_id + item_id"), part(41, 1)), part(42, 9), pick("r_id <= 5", F.lit("G"), F.lit("-")), part(51, 4), pick("r_id = 3", F.lit("-"), part(55, 1)), F.expr("substring(seq, 56)"))
    return rows.select("item_id", "r_id", row.alias("row"), F.concat(part(1, 50), F.lit("-"), F.expr("substring(seq, 51)")).alias("consensus"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("int").alias("chrom"), F.floor(F.col("l_orderkey") / 3).alias("tx"), "l_linenumber")
    return rows.agg(F.min(F.col("l_partkey") * 10).cast("int").alias("exon_start")).select("chrom", "tx", "exon_start", (F.col("exon_start") + 9).alias("exon_end"))
