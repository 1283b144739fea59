"""Nearest references by an exact index: no pair is compared that can't be within the budget.

If two texts are within e edits and one is cut into e + 1 segments, one segment stands in the other unchanged. So references
(or, for infixes, the patterns) are cut, segments are joined by their first letters with the grams of the other side, and
only pairs that meet are aligned. The budget grows 0, 1, 3, 7, ...; a text leaves as soon as it has a reference within the
budget, as all that are as near have met it by then, so the nearest one and its ties are proven. Where a budget exceeds a
reference's length no segment is left, and texts meet references by their lengths.

All joins are on equal keys; a round works on what the rounds before left over, and is written before the next begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import kmers
from ..session import cut

#: Pairs of texts and references up to which the budget begins where all are within it: rounds would cost more than distances.
SMALL = 1_000_000
#: Lengths of the grams that segments are looked up by: the longest that fits.
GRAMS = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1)


def _gram_size(size: Column) -> Column:
    """The longest gram within a segment of a size, 0 where there is none."""
    return F.coalesce(*[F.when(size >= q, F.lit(q)) for q in GRAMS], F.lit(0))


def _segments(text: Column, e: Column) -> Column:
    """Of e + 1 even segments of a text: array of (q, gram, at), the first q letters of each and their place; a single one without a gram where segments would be empty."""
    n = F.length(text)
    start = lambda i: F.floor(i * n / (e + 1)).cast("int")
    q = _gram_size(F.floor(n / (e + 1)).cast("int"))
    made = F.transform(F.sequence(F.lit(0), e), lambda i: F.struct(q.alias("q"), F.substring(text, start(i) + 1, q).alias("gram"), start(i).alias("at")))
    return F.when(q > 0, made).otherwise(F.array(F.struct(F.lit(0).alias("q"), F.lit("").alias("gram"), F.lit(0).alias("at"))))


def _grams(text: Column, sizes: list[int]) -> Column:
    """All grams of a text: array of (q, gram, at)."""
    none = F.array().cast("array<struct<q:int,gram:string,at:int>>")
    of = lambda q: F.coalesce(F.transform(kmers(text, q), lambda m: F.struct(F.lit(q).alias("q"), m["kmer"].alias("gram"), m["pos"].alias("at"))), none)
    return F.flatten(F.array(*[of(q) for q in sizes])) if sizes else none


def within(texts: DataFrame, refs: DataFrame, e: int, infix: bool = False) -> DataFrame:
    """(tid, rid) of pairs of texts (tid, t) and references (rid, rt) that may be within e edits: those that are, and few others.

    infix: the whole of t against any part of rt, instead of all of both; at a distance of t's length, where nothing of it is
    kept, a pair isn't found.
    """
    whole, parts, key, other = (refs, texts, "t", "rt") if infix else (texts, refs, "rt", "t")
    names = ("rid", "tid") if infix else ("tid", "rid")
    budget = F.greatest(F.least(F.lit(e), F.length(key) - 1), F.lit(0)) if infix else F.lit(e)
    cut_up = parts.select(F.col(names[1]), F.length(key).alias("n1"), F.explode(_segments(F.col(key), budget)).alias("s")).select(names[1], "n1", "s.*")
    sizes = sorted(r[0] for r in cut_up.select("q").distinct().collect() if r[0] > 0)
    found = whole.select(F.col(names[0]), F.length(other).alias("n2"), F.explode(_grams(F.col(other), sizes)).alias("g")).select(names[0], "n2", F.col("g.q").alias("q"), F.col("g.gram").alias("gram"), F.col("g.at").alias("place"))
    pairs = cut_up.filter("q > 0").join(found, ["q", "gram"])
    if infix:
        return pairs.select("tid", "rid").distinct()
    near = pairs.filter((F.abs(F.col("place") - F.col("at")) <= e) & (F.abs(F.col("n1") - F.col("n2")) <= e))
    near_lengths = F.sequence(F.greatest(F.length("t") - e, F.lit(0)), F.lit(e))  # references without segments have e letters at most
    lengths = texts.filter(F.length("t") <= 2 * e).select("tid", F.explode(near_lengths).alias("n1"))
    short = cut_up.filter("q = 0").select("rid", "n1").join(lengths, "n1")
    return near.select("tid", "rid").unionByName(short.select("tid", "rid")).distinct()


def nearest_pairs(texts: DataFrame, refs: DataFrame, most: int, distance: Callable[[Column, Column, int], Column], infix: bool = False) -> DataFrame:
    """(tid, rid, ed): for each text (tid, t) all references (rid, rt) at its smallest distance, below `most`.

    distance(t, rt, e) gives the distance, or a negative number beyond e. Neither text may be null. infix: as for within(); a
    text that keeps nothing in any reference has one row with a null rid, as all are as far.
    """
    left, out, e = texts, None, 0
    if not infix:
        (n, longest), (m, long_ref) = (df.agg(F.count("*"), F.coalesce(F.max(F.length(c)), F.lit(0))).first() for df, c in ((texts, "t"), (refs, "rt")))
        if n * m <= SMALL:
            e = min(most - 1, max(longest, long_ref))
    while True:
        met = within(left, refs, e, infix).join(left, "tid").join(refs, "rid").withColumn("ed", distance(F.col("t"), F.col("rt"), e)).filter((F.col("ed") >= 0) & (F.col("ed") <= e))
        scored = cut(met.select("tid", "rid", "ed"), "within")
        if infix:  # with the whole of it away, a text is as far from any reference
            lost = left.filter(F.length("t") <= e).select("tid", F.lit(None).cast(refs.schema["rid"].dataType).alias("rid"), F.length("t").alias("ed"))
            scored = scored.unionByName(lost.join(scored.select("tid").distinct(), "tid", "left_anti"))
        best = scored.groupBy("tid").agg(F.min("ed").alias("ed"))
        found = scored.join(best, ["tid", "ed"]).select("tid", "rid", "ed")
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(best.select("tid"), "tid", "left_anti"), "left")
        if e >= most - 1 or left.isEmpty():
            return out
        e = min(2 * e + 1, most - 1)


def numbered(df: DataFrame, text: str, name: str, number: str) -> DataFrame:
    """(number, name) of the distinct texts of a column, numbered once and for all."""
    rows = df.select(F.col(text).alias(name)).filter(F.col(name).isNotNull()).distinct()
    return cut(rows.select(F.monotonically_increasing_id().alias(number), name), "texts")
