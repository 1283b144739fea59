"""Connected components in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root): the smallest id that every id of edges (a, b) reaches. Each round is written and cuts lineage.

    In a round every id takes the smallest grandparent that it or a neighbour has, and offers its neighbours' to its
    parent, so whole trees hook to smaller ones and paths halve: rounds grow with the logarithm of a chain's length. A
    round without a change is the end, as then neighbours have one root; ids only get smaller, so it comes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = shared.cut(both, f"{name}-edges")
    state = shared.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), f"{name}-0")
    turn, changed = 0, True
    while changed:
        turn += 1
        up = state.select(F.col("id").alias("p"), F.col("root").alias("up"))
        grand = state.join(up, state["root"] == up["p"]).select("id", "root", "up")
        near = both.join(grand.select(F.col("id").alias("b"), F.col("up").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        own = F.struct("id", F.least("up", "r").alias("r"), "root")
        hook = F.struct(F.col("root").alias("id"), "r", F.lit(None).cast("long").alias("root"))
        offers = grand.join(near, grand["id"] == near["a"]).select(F.explode(F.array(own, hook)).alias("o")).select("o.*")
        new = shared.cut(offers.groupBy("id").agg(F.min("r").alias("new"), F.max("root").alias("root")), f"{name}-{turn}")
        changed = bool(new.filter("new <> root").limit(1).count())
        state = new.select("id", F.col("new").alias("root"))
    return state
