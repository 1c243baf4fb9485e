"""K nearest labelled sequences by the share of mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.bits import mismatches
from strandmill.functions.sequence import right_repad
from strandmill.operators.hamming import longest, with_planes
from strandmill.plans.skew import in_blocks
from strandmill.plans.storage import Workspace


def k_nearest(queries: DataFrame, train: DataFrame, *, k: int = 5, width: int = 20) -> DataFrame:
    """q_id, id, target, dist, r of the k nearest training rows of every query row; ties by id.

    Sequences of any length are padded on the right to `width`; those of unequal padded length don't meet. A first pass
    over the blocks counts how often each distance occurs, which says how far a query has to look; a second one takes the
    rows so near. So only those few are ordered.
    """
    space = Workspace(queries.sparkSession, "knn")
    padded = lambda df, *more: df.where(F.col("seq").isNotNull()).select("id", *more, right_repad(F.col("seq"), width).alias("seq"))
    q, t = padded(queries), padded(train, "target")
    max_len = max(longest(q), longest(t))
    q = space.save(with_planes(q, max_len).drop("seq"))
    t, n = space.save_counted(with_planes(t, max_len).drop("seq"))
    misses, same_length = mismatches("q", "p", max_len).cast("int"), F.col("q.len") == F.col("p.len")
    often = in_blocks(q, t, by="id", rows=n, on=same_length).groupBy(F.col("q.id").alias("id"), misses.alias("misses")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("id").orderBy("misses")) - F.col("n")
    reach = often.withColumn("before", before).where(F.col("before") < k).groupBy("id").agg(F.max("misses").alias("reach"))
    near = in_blocks(q.join(reach, "id"), t, by="id", rows=n, on=same_length & (misses <= F.col("q.reach")))
    near = near.select(F.col("q.id").alias("q_id"), F.col("p.id").alias("id"), F.col("p.target").alias("target"), misses.alias("misses"), F.col("q.len").alias("width"))
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("q_id").orderBy("misses", "id"))).where(F.col("r") <= k)
    return ranked.select("q_id", "id", "target", (F.col("misses") / F.col("width")).alias("dist"), "r")


def predicted(neighbours: DataFrame) -> DataFrame:
    """id, prediction: the mean target of the neighbours, a vote share for 0/1 labels."""
    return neighbours.groupBy(F.col("q_id").alias("id")).agg(F.avg("target").alias("prediction"))
