"""Connected components by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.plans.skew import lookup
from strandmill.plans.storage import Workspace


def _star(edges: DataFrame, n: int, *, large: bool) -> DataFrame:
    """One step: neighbours of each node are linked to the smallest of them, or the node itself.

    large: neighbours greater than the node; small: the node's smaller neighbours. Both keep components whole. A node with
    very many neighbours is only aggregated, then looked up: no list of neighbours is formed. n: no fewer than the edges.
    """
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        ends = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = ends.distinct()
    else:
        ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = lookup(ends, least, "u", rows=2 * n)
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = linked.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return out.where(F.col("src") != F.col("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of edges (src, dst): the smallest id of its component. Loops and null ends link nothing."""
    space = Workspace(edges.sparkSession, "components")
    now, n = space.save_counted(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    last = None
    while True:
        between = space.save(_star(now, n, large=True))
        after = space.save(_star(between, 2 * n, large=False))
        space.drop(now, between)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if (mark := (state[0], state[1])) == last:
            break
        last, now, n = mark, after, state[0]
    labels = after.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
