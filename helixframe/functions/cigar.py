"""Expressions over CIGAR strings, and an Arrow kernel that parses many at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column, kinds: str = "=XIDMNSHP") -> Column:
    """array of (n, op), in order."""
    pattern = rf"(\d+)([{kinds}])"
    return F.transform(
        F.regexp_extract_all(cigar, F.lit(pattern), F.lit(0)),
        lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")),
    )


def total(ops: Column, kinds: str, below: int | None = None) -> Column:
    """Sum of lengths over operations of these kinds, optionally only those shorter than `below`."""
    wanted = F.filter(ops, lambda o: o["op"].isin(*kinds) & (F.lit(True) if below is None else o["n"] < below))
    return F.aggregate(wanted, F.lit(0), lambda acc, o: acc + o["n"])


def reference_places(ops: Column, start: Column) -> Column:
    """Each operation with the reference position where it begins: array of (n, op, pos)."""
    return F.aggregate(
        ops,
        F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<n:int,op:string,pos:int>>").alias("out")),
        lambda acc, o: F.struct(
            (acc["at"] + F.when(o["op"].isin(*"=XMDN"), o["n"]).otherwise(0)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(o["n"].alias("n"), o["op"].alias("op"), acc["at"].alias("pos")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def gapped(cigar: Column, query: Column, target: Column) -> Column:
    """(query_aln, target_aln) of an extended CIGAR; I takes from the query, D from the target."""
    start = F.struct(F.lit(1).alias("q"), F.lit(1).alias("t"), F.lit("").alias("query_aln"), F.lit("").alias("target_aln"))

    def step(acc: Column, o: Column) -> Column:
        in_q, in_t = o["op"] != "D", o["op"] != "I"
        gap = F.repeat(F.lit("-"), o["n"])
        return F.struct(
            (acc["q"] + F.when(in_q, o["n"]).otherwise(0)).alias("q"),
            (acc["t"] + F.when(in_t, o["n"]).otherwise(0)).alias("t"),
            F.concat(acc["query_aln"], F.when(in_q, F.substring(query, acc["q"], o["n"])).otherwise(gap)).alias("query_aln"),
            F.concat(acc["target_aln"], F.when(in_t, F.substring(target, acc["t"], o["n"])).otherwise(gap)).alias("target_aln"),
        )

    return F.aggregate(operations(cigar, "=XID"), start, step, lambda acc: F.struct(acc["query_aln"].alias("query_aln"), acc["target_aln"].alias("target_aln")))


#: Kinds of operations by their numbers.
_KINDS = "=XIDMNSHP"
_KIND = np.full(256, -1, np.int8)
_KIND[[ord(ch) for ch in _KINDS]] = np.arange(len(_KINDS))
PARTS = "struct<ins:int,del:int,short:int,subs:int,matches:int,stop:int,gaps:array<struct<intron:boolean,start:int,stop:int>>>"


def parts(cigar: Column, start: Column, min_intron: int) -> Column:
    """What an evaluation asks of a CIGAR, from one pass over a batch of them as bytes: bases inserted, deleted (short: by deletions below
    min_intron), substituted and matched, where the alignment ends on the reference, and its introns (N) and deletions (D), in order."""

    @F.arrow_udf(PARTS)
    def run(cigars: pa.Array, starts: pa.Array) -> pa.Array:
        return parsed(cigars, starts, min_intron)

    return run(cigar, start.cast("int"))


def parsed(cigars: pa.Array, starts: pa.Array, min_intron: int) -> pa.Array:
    """The kernel of parts. Signs that no number stands before are passed over, as in operations."""
    rows, none = len(cigars), cigars.is_null().to_numpy(False)
    texts = pa.array(cigars.fill_null(""), pa.large_string()) if not pa.types.is_large_string(cigars.type) else cigars.fill_null("")
    _, ends, data = texts.buffers()
    edges = np.frombuffer(ends, np.int64, rows + 1, 8 * texts.offset)
    signs = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    edges = edges - edges[0]
    digit = (signs >= 48) & (signs <= 57)
    after = np.append(False, digit[:-1])[: len(signs)]
    after[edges[:-1][edges[:-1] < len(signs)]] = False
    at = np.flatnonzero((_KIND[signs] >= 0) & after)
    row, kind = np.searchsorted(edges, at, "right") - 1, _KIND[signs[at]]
    size, place, weight, here = np.zeros(len(at), np.int64), at - 1, 1, np.ones(len(at), bool)
    while here.any():
        size[here] += (signs[place[here]].astype(np.int64) - 48) * weight
        here &= place > edges[row]
        place -= 1
        here[here] = digit[place[here]]
        weight *= 10
    sums = lambda mask: np.bincount(row[mask], size[mask], rows).astype(np.int64)
    of = {ch: kind == i for i, ch in enumerate(_KINDS)}
    deleted = of["D"]
    onward = np.where(of["="] | of["X"] | of["M"] | of["D"] | of["N"], size, 0)
    passed = np.cumsum(onward) - onward
    first = np.searchsorted(row, np.arange(rows))
    base = np.append(passed, 0)[np.minimum(first, len(passed))] if len(passed) else np.zeros(rows, np.int64)
    begin, unplaced = starts.fill_null(0).to_numpy(False).astype(np.int64), starts.is_null().to_numpy(False)
    spot = begin[row] + passed - base[row]
    gap = deleted | of["N"]
    lost = unplaced[row[gap]]
    places = [pa.array(of["N"][gap]), pa.array(spot[gap], pa.int64(), mask=lost).cast(pa.int32()), pa.array((spot + size)[gap], pa.int64(), mask=lost).cast(pa.int32())]
    offsets = np.append(0, np.cumsum(np.bincount(row[gap], minlength=rows)))
    gaps = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(places, ["intron", "start", "stop"]))
    stop = pa.array(begin + np.bincount(row, onward, rows).astype(np.int64), pa.int64(), mask=none | unplaced).cast(pa.int32())
    numbers = [pa.array(sums(m), pa.int64(), mask=none).cast(pa.int32()) for m in (of["I"], deleted, deleted & (size < min_intron), of["X"], of["="])]
    return pa.StructArray.from_arrays([*numbers, stop, gaps], ["ins", "del", "short", "subs", "matches", "stop", "gaps"])
