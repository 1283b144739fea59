"""The column rules of a multialignment as relations, so that an interval with many readers spreads over tasks.

An interval is a key (`item_id`) with one consensus row and many reader rows of the same length. A column's contexts come from
counts over all rows; which of them stand beside the consensus is an ordered fold over the column's contexts, in array
expressions; the rules then look only at the places where a reader differs from the consensus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .udfs import windows_udf

LEAST_DEPTH = 5
LEAST_SUPPORT = 3


def bare(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def compressed(text: Column) -> Column:
    """Runs of one base as one base."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def thresholds(rows: DataFrame, ratio: float, key: str = "item_id") -> DataFrame:
    """key, threshold: the depth that a variant needs, a share of the readers and three at least."""
    return rows.groupBy(key).agg(F.greatest(F.lit(float(LEAST_SUPPORT)), F.count("*") * ratio).alias("threshold"))


def windows(centers: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """key, col, start, stop of (key, consensus): half a k-mer of bases and their gaps to either side of each column."""
    return centers.select(key, F.posexplode(windows_udf("consensus", F.lit(k // 2))).alias("col", "w")).select(key, "col", "w.start", "w.stop")


def contexts(rows: DataFrame, wins: DataFrame, limits: DataFrame, key: str = "item_id") -> DataFrame:
    """key, col, variant, context, depth, rank: contexts of all rows, the consensus among them, that are no noise; deepest first, then by text.

    Equal rows are counted before they are cut into columns.
    """
    centers = rows.select(key, F.col("consensus").alias("row")).distinct()
    every = rows.select(key, "row").unionByName(centers).groupBy(key, "row").agg(F.count("*").alias("times"))
    part = every.join(wins, key).select(key, "col", F.substring("row", F.col("col") + 1, F.lit(1)).alias("variant"), F.substring("row", F.col("start") + 1, F.col("stop") - F.col("start")).alias("context"), "times")
    depth = part.groupBy(key, "col", "variant", "context").agg(F.sum("times").alias("depth"))
    kept = depth.join(limits, key).filter(F.col("depth") > F.greatest(F.col("threshold") / 10, F.lit(float(LEAST_DEPTH)))).drop("threshold")
    order = Window.partitionBy(key, "col").orderBy(F.desc("depth"), "context")
    return kept.withColumn("rank", F.row_number().over(order).cast("long"))


def alternatives(found: DataFrame, centers: DataFrame, wins: DataFrame, limits: DataFrame, key: str = "item_id") -> DataFrame:
    """key, col, alternatives: array of (variant, context, depth) that stand beside the consensus, in order of filing; columns without any are left out.

    Filed at first are the consensus's own text and its form without runs. A context whose form without runs is filed is passed
    over. Otherwise both its forms are compared with every filed one; if its depth reaches the threshold over the least
    distance, it is filed in the form that came closest, in the place of one that is filed so.
    """
    item = F.struct("rank", "variant", "context", "depth")
    columns = found.groupBy(key, "col").agg(F.array_sort(F.collect_list(item)).alias("found"), F.count_distinct("variant").alias("variants")).filter("variants > 1")
    plain = bare(F.substring("consensus", F.col("start") + 1, F.col("stop") - F.col("start")))
    columns = columns.join(wins, [key, "col"]).join(centers, key).join(limits, key).withColumn("plain", plain).withColumn("short", compressed(F.col("plain")))
    nothing = F.lit(None).cast("struct<variant:string,context:string,depth:bigint>")
    entry = lambda form, held: F.struct(form.alias("form"), held.alias("held"))
    own = F.array_distinct(F.array(entry(F.col("short"), nothing), entry(F.col("plain"), nothing)))

    def file(filed: Column, x: Column) -> Column:
        text = bare(x["context"])
        short = compressed(text)
        one = lambda f, i: F.array(*[F.struct(F.levenshtein(f["form"], t).alias("d"), (i * 2 + j).alias("at"), t.alias("form")) for j, t in enumerate((text, short))])
        nearest = F.array_min(F.flatten(F.transform(filed, one)))
        held = F.struct(x["variant"].alias("variant"), x["context"].alias("context"), x["depth"].alias("depth"))
        known = F.exists(filed, lambda f: f["form"] == nearest["form"])
        put = F.when(known, F.transform(filed, lambda f: F.when(f["form"] == nearest["form"], entry(f["form"], held)).otherwise(f))).otherwise(F.concat(filed, F.array(entry(nearest["form"], held))))
        deep = x["depth"] >= F.col("threshold") / F.greatest(F.lit(1.0), nearest["d"].cast("double"))
        return F.when(~F.exists(filed, lambda f: f["form"] == short) & deep, put).otherwise(filed)

    filed = F.aggregate("found", own, file)
    admitted = F.transform(F.filter(filed, lambda f: (f["form"] != F.col("plain")) & (f["form"] != F.col("short"))), lambda f: f["held"])
    return columns.select(key, "col", admitted.alias("alternatives")).filter(F.size("alternatives") > 0)


def corrections(rows: DataFrame, wins: DataFrame, others: DataFrame, limits: DataFrame, key: str = "item_id") -> DataFrame:
    """key, r_id, col, base: what stands, after correction, where a reader differs from the consensus.

    With alternatives: the variant of the one that is the reader's context; else that of the nearest context, the consensus first
    of equal ones. Without: the reader's base if neither side is a gap, enough readers have it, and both sides of its context
    are the consensus's; else the consensus's.
    """
    places = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.length("row") - 1))).withColumns({"own": F.substring("row", F.col("col") + 1, F.lit(1)), "ref": F.substring("consensus", F.col("col") + 1, F.lit(1))}).filter("own <> ref")
    depth = places.groupBy(key, "col", "own").agg(F.count("*").alias("depth"))
    window = lambda text: F.substring(text, F.col("start") + 1, F.col("stop") - F.col("start"))
    sides = [F.substring(F.col(t), a + 1, n) for a, n in ((F.col("start"), F.col("col") - F.col("start")), (F.col("col") + 1, F.col("stop") - F.col("col") - 1)) for t in ("row", "consensus")]
    held = places.join(wins, [key, "col"]).join(depth, [key, "col", "own"]).join(others, [key, "col"], "left").join(limits, key).withColumns({"context": window("row"), "center": window("consensus")})
    same = F.filter("alternatives", lambda x: x["context"] == F.col("context"))
    far = lambda text: F.levenshtein(bare(text), bare(F.col("context")))
    center = F.struct(far(F.col("center")).alias("d"), F.lit(-1).alias("n"), F.col("ref").alias("base"))
    nearest = F.array_min(F.concat(F.array(center), F.transform("alternatives", lambda x, i: F.struct(far(x["context"]).alias("d"), i.alias("n"), x["variant"].alias("base")))))
    plain = F.when((F.col("own") != "-") & (F.col("ref") != "-") & (F.col("depth") >= F.col("threshold")) & (sides[0] == sides[1]) & (sides[2] == sides[3]), F.col("own")).otherwise(F.col("ref"))
    base = F.when(F.col("alternatives").isNull(), plain).when(F.size(same) > 0, F.get(same, F.lit(0))["variant"]).otherwise(nearest["base"])
    return held.select(key, "r_id", "col", base.alias("base"))


def corrected(rows: DataFrame, k: int, ratio: float, key: str = "item_id") -> DataFrame:
    """key, r_id, corrected of rows (key, r_id, row, consensus): the column rules, without gaps.

    A reader's row is put together again from the consensus and the places where the rules give another base.
    """
    centers = rows.select(key, "consensus").distinct()
    wins, limits = windows(centers, k, key), thresholds(rows, ratio, key)
    others = alternatives(contexts(rows, wins, limits, key), centers, wins, limits, key)
    changed = corrections(rows, wins, others, limits, key).groupBy(key, "r_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "base"))).alias("put"))
    text = F.array_join(F.transform(F.split("consensus", ""), lambda c, i: F.coalesce(F.try_element_at("put", i), c)), "")
    return rows.select(key, "r_id", "consensus").join(changed, [key, "r_id"], "left").select(key, "r_id", bare(F.when(F.col("put").isNull(), F.col("consensus")).otherwise(text)).alias("corrected"))


def corrected_spans(rows: DataFrame, k: int, ratio: float, key: str = "item_id") -> DataFrame:
    """key, r_id, start, stop, weight, text: what every reader of an interval, the current one among them, is corrected to there.

    rows have q1 and q2 besides, where the reader's segment begins and where its last k-mer does. Anchors are cut off: the span is
    [q1 + k, q2), and the weight is the number of readers.
    """
    readers = rows.groupBy(key).agg(F.count("*").alias("weight"))
    text = F.substring("corrected", F.lit(k + 1), F.greatest(F.length("corrected") - 2 * k, F.lit(0)))
    done = corrected(rows, k, ratio, key).select(key, "r_id", text.alias("text"))
    return rows.select(key, "r_id", (F.col("q1") + k).alias("start"), F.col("q2").alias("stop")).join(done, [key, "r_id"]).join(readers, key).select(key, "r_id", "start", "stop", "weight", "text")
