"""Sharding into near equal bytes by sampled splitters.

Records have a key (60 bits of the MD5 of the text), so copies of a text lie side by side in key order. Keys are
drawn in proportion to their bytes and rows, quantiles of the draws are the boundaries of fine ranges, and records
are dealt to the ranges. A range that holds over four times its share of bytes or rows is drawn from again until it
doesn't or is a single key; a single key with many rows is cut along a hash of the ids. Bytes and rows
of all pieces are summed exactly, so each record knows its place in the order of (key, hash of id, id): what was drawn
decides only how the work is spread, never the result.

A shard is a stretch of that order. Its ends are where equal shares of the bytes end, moved to the nearest
edge between two texts if one lies within `slack` of a share (1%); else the cut goes between two rows of a text. So a
shard is within 2% of a share, give or take a row, and at most shards - 1 texts have copies in more than one shard.

What reaches the driver: DRAWS keys for each range (ranges: RANGES for each shard, or one for each RANGE_ROWS rows), the
ranges found overfull, and a row for each inner end. Broadcast: two rows for each range and one for each
piece of a cut key, 8 numbers each. All else is shuffled by (range, piece).

Defined cases: a null text has no bytes (size 8, crc32 0) and is of one group with empty texts; a null id comes before
all others and is spread as 0; repeated rows are rows of their own, in any order; an empty table gives an empty result;
with fewer rows than shards some shards stay empty. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SHARDS = 24
SLACK = 0.01
#: Ranges for each shard at least, and rows for which there is one more beyond that.
RANGES = 64
RANGE_ROWS = 1_000_000
DRAWS = 4
OVERFULL = 4
EXTRA = 8


def digits(value: Column, n: int) -> Column:
    """The first n hexadecimal digits of the MD5 of a text or bytes, as a number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, n), 16, 10).cast("long")


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def _range_of(splitters: np.ndarray):
    """Number of a key's range: 2 i below splitter i, 2 i + 1 at it."""

    @F.pandas_udf("long")
    def number(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(splitters, keys.to_numpy())
        same = np.append(splitters, -1)[at] == keys.to_numpy()
        return pd.Series(2 * at + same)

    return number


def _draws(groups: DataFrame, rate_bytes: float, rate_rows: float, salt: int) -> DataFrame:
    """(key, draws): each group about bytes * rate_bytes + rows * rate_rows times."""
    u = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return groups.select("key", F.floor(F.col("bytes") * rate_bytes + F.col("rows") * rate_rows + u).alias("draws")).filter("draws > 0")


def splitters(groups: DataFrame, total: int, rows: int, ranges: int) -> np.ndarray:
    """Keys that bound the ranges: weighted quantiles of the draws, and more where ranges are overfull."""
    drawn = _draws(groups, DRAWS * ranges / 2 / total, DRAWS * ranges / 2 / rows, 0).toPandas().sort_values("key")
    ends = np.cumsum(drawn["draws"].to_numpy(np.int64))
    marks = np.arange(DRAWS, ends[-1] if len(ends) else 0, DRAWS)
    found = np.unique(drawn["key"].to_numpy(np.int64)[np.searchsorted(ends, marks)])
    salt = 0
    while True:
        salt += 1
        number = _range_of(found)(F.col("key")).alias("range")
        held = groups.select(number, "key", "bytes", "rows").groupBy("range").agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("keys"), F.max_by("key", F.col("bytes") / total + F.col("rows") / rows).alias("heavy")
        )
        over = held.filter((F.col("keys") > 1) & ((F.col("bytes") > OVERFULL * total / ranges) | (F.col("rows") > OVERFULL * rows / ranges))).toPandas()
        if over.empty:
            return found
        inside = F.broadcast(groups.sparkSession.createDataFrame(over[["range"]]))
        again = groups.select("*", number).join(inside, "range")
        more = _draws(again, ranges / total, ranges / rows, salt).toPandas()["key"].to_numpy(np.int64)
        found = np.unique(np.concatenate([found, more, over["heavy"].to_numpy(np.int64)]))


def _inner_ends(groups: DataFrame, starts: DataFrame, number, total: int, shards: int, slack: float) -> list[int]:
    """Offsets in bytes at which shards 1, 2, ... begin."""
    even = [total * j // shards for j in range(1, shards)]
    spans = starts.groupBy("range").agg(F.min("b0").alias("b0"), F.sum("bytes").alias("span"))
    wanted = F.array(*[F.lit(t).cast("long") for t in even])
    hit = spans.filter(F.exists(wanted, lambda t: (t >= F.col("b0")) & (t < F.col("b0") + F.col("span")))).select("range", "b0")
    near = groups.select("key", "bytes", number(F.col("key")).alias("range")).join(F.broadcast(hit), "range")
    before = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    edges = near.withColumn("g0", F.col("b0") + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    cut = edges.filter(F.exists(wanted, lambda t: (t >= F.col("g0")) & (t < F.col("g0") + F.col("bytes")))).select("g0", (F.col("g0") + F.col("bytes")).alias("g1")).collect()
    room, out = int(total * slack / shards), []
    for t in even:
        g0, g1 = next((r.g0, r.g1) for r in cut if r.g0 <= t < r.g1)
        edge = g0 if t - g0 <= g1 - t else g1
        out.append(edge if abs(edge - t) <= room else t)
    return out


def place(df: DataFrame, size: Column, key: Column, order: Column, shards: int = SHARDS, slack: float = SLACK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """row (a struct of the columns of df), shard and slot (place in the shard, from 0)."""
    base = shared.cut(
        df.select(F.struct(*shared.columns(df)).alias("row"), size.cast("long").alias("size"), key.cast("long").alias("key"), order.cast("long").alias("id"), digits(F.coalesce(order.cast("string"), F.lit("")), 8).alias("spread")),
        "shard-rows",
    )
    groups = shared.cut(base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if not rows:
        return base.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(RANGES * shards, -(-rows // range_rows))
    number = _range_of(splitters(groups, total, rows, ranges))
    hot = groups.filter(F.col("rows") > rows / ranges).select(F.col("key").alias("hot"), F.ceil(F.col("rows") * ranges / rows).cast("long").alias("parts"))
    placed = base.withColumn("range", number(F.col("key")))
    single = F.col("range") % 2 == 1
    placed = placed.join(F.broadcast(hot), (F.col("key") == F.col("hot")) & single, "left").withColumn(
        "piece", F.coalesce(F.shiftright(F.col("spread") * F.col("parts"), 32), F.lit(0))
    )
    pieces = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared.cut(pieces.withColumns({"b0": F.coalesce(F.sum("bytes").over(ahead), F.lit(0)), "r0": F.coalesce(F.sum("rows").over(ahead), F.lit(0))}), "shard-starts")
    ends = _inner_ends(groups, starts, number, total, shards, slack)
    inside = Window.partitionBy("range", "piece").orderBy("key", "spread", F.col("id").asc_nulls_first(), "size")
    offset = F.col("b0") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def offsets(some: DataFrame) -> DataFrame:
        known = F.broadcast(some.select("range", "piece", "bytes", "b0", "r0"))
        return placed.join(known, ["range", "piece"]).withColumns({"offset": offset, "rank": F.col("r0") + F.row_number().over(inside) - 1})

    # Rows before an end: those before the piece that holds it, and those of the piece that begin before it.
    held = [(F.lit(e).cast("long") >= F.col("b0")) & (F.lit(e).cast("long") < F.col("b0") + F.col("bytes")) for e in ends]
    before = [F.max(F.when(h, F.greatest("r0", F.when(F.col("offset") < e, F.col("rank") + 1)))).alias(f"e{j}") for j, (h, e) in enumerate(zip(held, ends, strict=True))]
    firsts = [0] + ([rows if x is None else x for x in offsets(starts.filter(reduce(lambda x, y: x | y, held))).agg(*before).first()] if ends else [])
    shard = reduce(lambda a, b: a + b, [(F.col("offset") >= e).cast("int") for e in ends], F.lit(0))
    table = F.array(*[F.lit(f).cast("long") for f in firsts])
    return offsets(starts).withColumn("shard", shard).select("row", "shard", (F.col("rank") - F.get(table, F.col("shard"))).alias("slot"))


def shard(docs: DataFrame, text: str = "text", order: str = "doc_id", **settings) -> DataFrame:
    """docs with size, text_crc32, shard and slot; these replace columns so named."""
    new = {"size": text_size(text), "text_crc32": text_crc32(text), "shard": F.lit(0), "slot": F.lit(0)}
    kept = docs.select(*[c for c, name in zip(shared.columns(docs), docs.columns, strict=True) if name.lower() not in new])
    names = shared.fresh(docs.columns, "__size", "__crc")
    held = docs.select(*shared.columns(kept), new["size"].alias(names[0]), new["text_crc32"].alias(names[1]))
    placed = place(held, F.col(names[0]), digits(F.coalesce(F.col(text), F.lit("")), 15), F.col(order), **settings)
    return placed.select(*[F.col(f"row.`{c}`") for c in kept.columns], F.col(f"row.{names[0]}").alias("size"), F.col(f"row.{names[1]}").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 200_000, **settings) -> None:
    """docs under path/shard=N, in the order of slots; a shard is written by as many tasks as it has files."""
    out = shard(docs, **settings)
    dealt = out.repartition(F.col("shard"), F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot, grown_shard."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", text_size().alias("size"), text_crc32().alias("text_crc32"), digits(F.coalesce(F.col("text"), F.lit("")), 15).alias("key"))
    placed = place(docs, F.col("size"), F.col("key"), F.col("doc_id"))
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by its rule."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


#: CRC-32 in SQL: a fold over the bytes in hexadecimal.
CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || b)::bigint for b in regexp_extract_all(hex(encode({text})), '..')]), "
    f"lambda c, b: xor(c >> 8, {_crc_table()}[xor(c & 255, b) + 1])), 4294967295::bigint)"
)

ORACLE = f"""
with d as (
  select doc_id, strlen(coalesce(text, '')) + 8 as size, {CRC_SQL.format(text="coalesce(text, '')")} as crc,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as key,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as spread from documents),
t as (select sum(size)::bigint as total from d),
o as (
  select *, coalesce(sum(size) over w, 0)::bigint as off, row_number() over (order by key, spread, doc_id nulls first, size) - 1 as rk
  from d window w as (order by key, spread, doc_id nulls first, size rows between unbounded preceding and 1 preceding)),
g as (select min(off) as g0, max(off + size) as g1 from o group by key),
e as (select j, total * j // {SHARDS} as even, floor(total * {SLACK}::double / {SHARDS})::bigint as room from t, range(1, {SHARDS}) r(j)),
b as (
  select case when abs(edge - even) <= room then edge else even end as bound
  from (select *, case when even - g0 <= g1 - even then g0 else g1 end as edge from e join g on g0 <= even and even < g1)),
s as (select o.*, (select count(*) from b where bound <= off)::int as shard from o)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard, rk - min(rk) over (partition by shard) as slot, null::int as grown_shard from s
"""
