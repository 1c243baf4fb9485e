"""Classification metrics and ensemble votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(votes: list[Column]) -> Column:
    """1 if more than half vote 1; a tie gives 0."""
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return (total * 2 > len(votes)).cast("int")


def nonspecific(*targets: Column) -> Column:
    total = targets[0]
    for t in targets[1:]:
        total = total + t
    return F.when(total > 0, "Non-specific").otherwise("Anti-id (specific)")


def confusion(scored: DataFrame, *, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp, fp, tn, fn, balanced_accuracy, precision. Shares without rows are null."""
    on = lambda l, p: F.count_if((F.col(label) == l) & (F.col(prediction) == p))
    c = scored.agg(on(1, 1).alias("tp"), on(0, 1).alias("fp"), on(0, 0).alias("tn"), on(1, 0).alias("fn"))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return c.withColumns({"balanced_accuracy": (rate("tp", "fn") + rate("tn", "fp")) / 2, "precision": rate("tp", "fp")})


def roc_auc(scored: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    """auc by the sum of average ranks. Rows are first counted by score, and the running count is formed in two levels, so no task sorts everything."""
    by = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    from pyspark.sql import Window as W

    from strandmill.plans.storage import Workspace

    parts = Workspace(scored.sparkSession, "auc").save(by.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum("neg").alias("n"))  # one row for each partition
    base = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    below = F.sum("neg").over(W.partitionBy("part").orderBy("s")) - F.col("neg")
    ranked = parts.withColumn("below", below).join(F.broadcast(base), "part")
    won = F.col("pos") * (F.col("below") + F.col("base") + F.col("neg") / 2)
    return ranked.agg(F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
