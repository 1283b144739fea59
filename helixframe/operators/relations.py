"""Steps of the correction as relations: which anchors are still open, and the segments that support them.

`open_anchors` holds the anchors of reads against the spans that were corrected already, in one sweep over starts of runs
and probes of each read. `support_exact` chooses for every open anchor the segment of each other read, by a table function
over each read's anchors in order, which carries what was measured for the read before. Both equal what the correction
of a whole batch does in one place, but reads spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import quality_prefix
from .alignment import Pattern


def runs_of(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, start, stop of the runs that spans [start, stop) cover together; spans that touch are in one run."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach, F.lit(True))
    marked = spans.filter("start < stop").withColumn("__new", new.cast("int"))
    numbered = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__run")


def open_anchors(pairs: DataFrame, spans: DataFrame, k: int, keys: tuple[str, ...] = ("cluster_id", "r_id")) -> DataFrame:
    """The pairs (keys, p1, p2 and more) that are to be corrected yet, with `across`: 0 for those with an inner end, p1 + k or
    p2 - 1, outside all spans, 1 for those whose ends lie in two different runs, across a gap. Pairs within one run are left out.

    Pairs and runs of a read meet in one window, sorted by position: the last run that began tells where a probe lies. Null keys
    are keys like others; a read without spans keeps all its pairs.
    """
    rest = [c for c in pairs.columns if c not in keys]
    probe = lambda side, at: F.struct(F.lit(side).alias("side"), at.cast("long").alias("at"))
    probes = pairs.select(*keys, F.struct(*rest).alias("pair"), F.explode(F.array(probe(0, F.col("p1") + k), probe(1, F.col("p2") - 1))).alias("x"))
    points = probes.select(*keys, "pair", "x.side", "x.at", F.lit(None).cast("long").alias("stop"))
    begins = runs_of(spans, keys).select(*keys, F.lit(None).cast(pairs.select(F.struct(*rest).alias("pair")).schema["pair"].dataType).alias("pair"), F.lit(-1).alias("side"), F.col("start").cast("long").alias("at"), F.col("stop").cast("long").alias("stop"))
    sweep = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = F.struct(F.last(F.when(F.col("side") < 0, F.col("at")), True).over(sweep).alias("start"), F.last("stop", True).over(sweep).alias("stop"))
    found = points.unionByName(begins).withColumn("run", run).filter("side >= 0")
    inside = F.when(F.col("at") < F.col("run.stop"), F.col("run.start"))
    ends = found.withColumn("inside", inside).groupBy(*keys, "pair").agg(F.max(F.when(F.col("side") == 0, F.col("inside"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("inside"))).alias("b"))
    across = F.when(F.col("a").isNull() | F.col("b").isNull(), 0).when(F.col("a") != F.col("b"), 1)
    return ends.withColumn("across", across).filter("across is not null").select(*keys, "pair.*", "across")


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


@F.udtf(returnType=_fields(cluster_id=T.StringType(), r_id=T.IntegerType(), p1=T.IntegerType(), p2=T.IntegerType(), weight=T.IntegerType(), rank=T.IntegerType(), other=T.IntegerType(), q1=T.IntegerType(), q2=T.IntegerType(), distance=T.DoubleType()))
class SupportOf:
    """Table function over the anchors of a read, partitioned by read and ordered as they are made.

    A row is an anchor: cluster_id, r_id, p1, p2, ref (its text), error (its mean error), and places, the array of (other, q1,
    q2, text, error) where it stands in other reads. Out come the chosen segments, the read's own first, then others in the
    order in which their reads were first taken. In turn, for each place:

    1. a text equal to the read's own has distance 0 and replaces what was chosen;
    2. a read that has a segment for this anchor is always aligned;
    3. a text that was met for this anchor has the distance it had then;
    4. a read whose last measured span encloses this one, on both sides, is estimated from it, if the estimate stays within
       the expected errors; an estimate isn't remembered as measured;
    5. all others are aligned, and left out beyond the length of the read's own text.
    A segment only replaces one that is farther.
    """

    def __init__(self) -> None:
        self.measured: dict[int, tuple[int, int, int, int, float]] = {}

    def eval(self, row: Any) -> Iterator[tuple]:
        own = (row["p1"], row["p2"])
        ref = row["ref"]
        chosen: dict[int, tuple[float, int, int]] = {row["r_id"]: (0.0, *own)}
        texts: dict[str, float] = {ref: 0.0}
        taken: set[int] = set()
        pattern = None
        for place in row["places"]:
            other, text = place["other"], place["text"]
            measured, distance = True, None
            if text == ref:
                distance = 0.0
            elif other not in taken and text in texts:
                distance = texts[text]
            elif other not in taken:
                distance = self._estimate(place, row, own, len(ref))
                measured = distance is None
            if distance is None:
                pattern = pattern or Pattern(ref)
                found = pattern.distance(text, len(ref))
                if found < 0:
                    continue
                distance = float(found)
            if text != ref and other in chosen and distance >= chosen[other][0]:
                continue
            chosen[other] = (distance, place["q1"], place["q2"])
            texts[text] = distance
            taken.add(other)
            if measured:
                self.measured[other] = (*own, place["q1"], place["q2"], distance)
        for rank, (other, (distance, q1, q2)) in enumerate(chosen.items()):
            yield row["cluster_id"], row["r_id"], *own, len(chosen), rank, other, q1, q2, distance

    def _estimate(self, place: Any, row: Any, own: tuple[int, int], length: int) -> float | None:
        if place["other"] not in self.measured:
            return None
        a1, a2, b1, b2, known = self.measured[place["other"]]
        q1, q2 = place["q1"], place["q2"]
        if not (b1 <= q1 and q2 <= b2 and a1 <= own[0] and own[1] <= a2):
            return None
        guess = known + abs((own[1] - a2) - (q2 - b2)) + abs((q1 - b1) - (own[0] - a1))
        return guess if guess <= (row["error"] + place["error"]) * length else None


def segments_of(reads: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """pairs (cluster_id, r_id, p1, p2 and more) with the text from the first base of p1's k-mer to the last of p2's, and its mean error.

    A read's sequence and qualities are needed once for all its pairs, so pairs are gathered and meet them in one row.
    """
    rest = [c for c in pairs.columns if c not in ("cluster_id", "r_id")]
    held = pairs.groupBy("cluster_id", "r_id").agg(F.collect_list(F.struct(*rest)).alias("pairs"))
    quality = F.coalesce("qual", F.repeat(F.lit("+"), F.length("seq")))
    rows = held.join(reads.select("cluster_id", "r_id", "seq", quality_prefix(quality).alias("sums")), ["cluster_id", "r_id"])
    size = lambda x: x["p2"] - x["p1"] + k
    cut = lambda x: F.struct(
        *[x[c].alias(c) for c in rest], F.substring("seq", x["p1"] + 1, size(x)).alias("text"), ((F.get("sums", x["p2"] + k) - F.get("sums", x["p1"])) / size(x)).alias("error")
    )
    return rows.select("cluster_id", "r_id", F.explode(F.transform("pairs", cut)).alias("x")).select("cluster_id", "r_id", "x.*")


def support_exact(reads: DataFrame, pairs: DataFrame, kept: DataFrame, opened: DataFrame, k: int) -> DataFrame:
    """cluster_id, r_id, p1, p2, weight, rank, other, q1, q2, distance: the segments that support the open anchors of every read.

    reads: cluster_id (text), r_id, seq, qual; pairs: cluster_id, r_id, ord (order of generation), m1, p1, m2, p2 of all reads;
    kept: the anchors (cluster_id, m1, m2) in use; opened: pairs as open_anchors gives them. Anchors of fewer than three places have
    no support. Null sequences have no pairs.
    """
    used = pairs.join(kept.select("cluster_id", "m1", "m2"), ["cluster_id", "m1", "m2"])
    texts = segments_of(reads, used, k)
    places = texts.groupBy("cluster_id", "m1", "m2").agg(F.array_sort(F.collect_list(F.struct("r_id", "ord", "p1", "p2", "text", "error"))).alias("found"))
    places = places.filter(F.size("found") >= 3)
    mine = opened.select("cluster_id", "r_id", "p1", "p2", "across").join(texts, ["cluster_id", "r_id", "p1", "p2"]).join(places, ["cluster_id", "m1", "m2"])
    others = F.filter("found", lambda x: x["r_id"] != F.col("r_id"))
    place = F.transform(others, lambda x: F.struct(x["r_id"].alias("other"), x["p1"].alias("q1"), x["p2"].alias("q2"), x["text"].alias("text"), x["error"].alias("error")))
    rows = mine.select("cluster_id", "r_id", "p1", "p2", F.col("text").alias("ref"), "error", place.alias("places"), "across", "ord")
    ordered = rows.asTable().partitionBy("cluster_id", "r_id").orderBy("p1", "across", "ord")
    return SupportOf(ordered)


def anchor_chains(anchors: DataFrame, keys: tuple[str, ...] = ("cluster_id", "r_id")) -> DataFrame:
    """keys, anchors, signature, first, reads: reads whose chosen anchors are the same, in the same order, make one transcript.

    anchors: keys, place (their order), m1, m2. The signature is a rolling hash along a read's anchors; reads that share it
    are told apart by the anchors themselves. `first` is the smallest read of a group and `reads` their number; counts are
    combined before they are shuffled, and no group is gathered. All but the last key say what is compared.
    """
    group, read = list(keys[:-1]), keys[-1]
    chain = F.array_sort(F.collect_list(F.struct("place", "m1", "m2")))
    plain = lambda xs: F.transform(xs, lambda x: F.concat_ws("-", x["m1"], x["m2"]))
    # Products modulo a prime below 2**31 stay within 64 bits.
    rolled = F.aggregate("chain", F.lit(7).cast("long"), lambda h, x: F.pmod(h * 1_000_003 + F.pmod(F.xxhash64(x), F.lit(2_147_483_647)), F.lit(2_147_483_647)))
    reads = anchors.groupBy(*keys).agg(plain(chain).alias("chain")).withColumn("signature", rolled)
    groups = reads.groupBy(*group, "signature", "chain").agg(F.min(read).alias("first"), F.count("*").alias("reads"))
    return reads.join(groups, [*group, "signature", "chain"]).select(*keys, F.size("chain").alias("anchors"), "signature", "first", "reads")
