"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Within a source every document has the same expected number of copies, r = target / source size. Documents
are put in a fixed order (bit length of the size, a slice of the ids, size, id, a hash of the row), expected copies
are summed along it, one random offset is added, and a document is emitted once per integer boundary that its share
of the sum crosses. As the order runs along sizes, the words taken stay close to the target. Each source draws its
offset from the seed and its name, so reruns agree.

The prefix sum is in two levels, so that a source with a third of all rows spreads over many tasks: slices
of about `slice_rows` documents, dealt by a hash of the id, are ranked each on its own, and slice counts are summed
over the few slices of a source.

Defined cases: null text and empty text have size 0 and are taken like any other row (0 words); a source of
only such rows has target 0 and no copies; the null source is a source, last in order; repeated rows are
rows of their own; a null id counts as 0 in the order; an empty table gives an empty result. Other columns
are carried along, whatever their names: rows travel as one struct beside the helper columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SLICE_ROWS = 4096
CAP = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Per source (columns __key, __none, source_size): target, from weights 1, 2, 3 repeating by code point.

    Water filling in closed form: by growing cap / weight, the first source whose cap is above its share of
    what the capped ones leave sets the level for itself and all after it.
    """
    ranked = sizes.withColumn("__w", (F.row_number().over(Window.orderBy("__none", "__key")) - 1) % 3 + 1)
    by = Window.orderBy((F.lit(float(cap)) * F.col("source_size") / F.col("__w")), "__none", "__key")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("__total", F.sum("source_size").over(every))
        .withColumn("__left", F.col("__total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("__share", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left").cast("double") / F.col("__share"))
        .withColumn("__free", F.col("__level") * F.col("__w") <= cap * F.col("source_size"))
        .withColumn("__level", F.first(F.when(F.col("__free"), F.col("__level")), ignorenulls=True).over(every))
    )
    capped = (F.lit(cap) * F.col("source_size")).cast("double")
    return level.select(
        "__key", "__none", "source_size", F.least(capped, F.coalesce(F.col("__level") * F.col("__w"), capped)).alias("target")
    )


def digits(value: Column) -> Column:
    """A number below 2**32 from a hash of a text."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long")


def _counted(
    docs: DataFrame, size: Column, source: str = "source", order: str = "doc_id", cap: int = CAP, seed: int = SEED, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """row (a struct of the columns of docs), source_size, target and copies."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    base = docs.select(
        F.struct(*shared.columns(docs)).alias("row"), F.coalesce(F.col(source), F.lit("")).alias("__key"), F.col(source).isNull().alias("__none"),
        size.cast("long").alias("__size"), F.coalesce(F.col(order), F.lit(0)).cast("long").alias("__id"), F.xxhash64(*plain).alias("__tie"),
    ).withColumn("__bits", F.length(F.bin("__size")))
    cells = base.groupBy("__key", "__none", "__bits").agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum"))
    slices = cells.select("__key", "__none", "__bits", F.ceil(F.col("__n") / slice_rows).cast("long").alias("__slices"))
    goal = targets(cells.groupBy("__key", "__none").agg(F.sum("__sum").alias("source_size")), cap)
    keys = ["__key", "__none", "__bits"]
    placed = base.join(slices, keys).withColumn("__slice", digits(F.col("__id").cast("string")) % F.col("__slices"))
    counts = placed.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("__key", "__none").orderBy("__bits", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).join(goal, ["__key", "__none"]).drop("__n")
    inside = Window.partitionBy(*keys, "__slice").orderBy("__size", "__id", "__tie")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = digits(F.concat(F.lit(f"{seed}:"), F.col("__none").cast("string"), F.col("__key"))) / F.lit(float(1 << 32))
    ranked = (
        placed.withColumn("__rank", F.row_number().over(inside))
        .join(starts, [*keys, "__slice"])
        .withColumn("__rank", F.col("__rank") + F.col("__ahead"))
        .withColumn("__ratio", ratio).withColumn("__offset", offset)
    )
    crossed = F.floor(F.col("__ratio") * F.col("__rank") + F.col("__offset")) - F.floor(F.col("__ratio") * (F.col("__rank") - 1) + F.col("__offset"))
    return ranked.select("row", "source_size", "target", crossed.cast("long").alias("copies"))


def copies(docs: DataFrame, size: str, **settings) -> DataFrame:
    """docs with source_size, target (its source's) and copies (how often the mix takes the row); these replace columns so named."""
    new = ["source_size", "target", "copies"]
    return _counted(docs, F.col(size), **settings).select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new], *new)


def emit(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs only."""
    taken = _counted(docs, n_words(text), **settings).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, source_size, target, taken (and copies, source)."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size"))
    mixed = copies(shared.cut(docs, "sizes"), "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


ORACLE = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
b as (select *, coalesce(source, '') as k, source is null as none, length(bin(size)) as bits, coalesce(doc_id, 0) as id from d),
s as (select k, none, sum(size)::bigint as source_size from b group by k, none),
w as (select *, (row_number() over (order by none, k) - 1) % 3 + 1 as w from s),
o as (select *, row_number() over (order by {float(CAP)} * source_size / w, none, k) as o from w),
l as (
  select *, (sum(source_size) over ())::bigint - {CAP} * coalesce(sum(source_size) over (order by o rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
    (sum(w) over ())::bigint - coalesce(sum(w) over (order by o rows between unbounded preceding and 1 preceding), 0)::bigint as share from o),
f as (select *, rest::double / share as lev, rest::double / share * w <= {CAP} * source_size as free from l),
v as (select lev from f where free order by o limit 1),
t as (select k, none, source_size, least(({CAP} * source_size)::double, coalesce((select lev from v) * w, ({CAP} * source_size)::double)) as target from f),
p as (select *, ('0x' || substr(md5(id::varchar), 1, 8))::bigint % n as sl from (
  select *, ceil(count(*) over (partition by k, none, bits) / {float(SLICE_ROWS)})::bigint as n from b)),
r as (select *, row_number() over (partition by k, none order by bits, sl, size, id) as rk from p),
m as (select r.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as q,
  ('0x' || substr(md5('{SEED}:' || none::varchar || k), 1, 8))::bigint / 4294967296.0::double as u from r join t using (k, none))
select doc_id, size, source_size, target, c * size as taken, source, c as copies from (
  select *, (floor(q * rk + u) - floor(q * (rk - 1) + u))::bigint as c from m)
"""
