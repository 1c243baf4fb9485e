"""Neighbour-embedding affinities within batches of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_SIZE, PERPLEXITY, TOLERANCE, TRIES = 5_000, 30.0, 1e-5, 50
#: Parts of a batch, each a unit of work that meets the whole batch.
PARTS = 20
EPSILON = float(np.finfo(float).eps)


def numbered(rows: DataFrame, order: str, *keep: str) -> tuple[DataFrame, int]:
    """row (from 0, in the order of an id) and the kept columns, and the number of rows.

    The running number comes from the counts of range partitions, not from one sorted task.
    """
    spread = rows.select(F.col(order).alias("k"), *keep).repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id())
    from strandmill.plans.storage import Workspace

    fixed = Workspace(rows.sparkSession, "batches").save(spread.withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("p").cast("bigint"), 33)))
    counts = {r["p"]: r["count"] for r in fixed.groupBy("p").count().collect()}  # one number for each partition
    before, starts = 0, {}
    for p in sorted(counts):
        starts[p] = before
        before += counts[p]
    first = F.create_map(*[x for p, n in starts.items() for x in (F.lit(p), F.lit(n))]) if starts else F.create_map().cast("map<int,int>")
    return fixed.select((F.col("at") + first[F.col("p")]).alias("row"), *keep), before


def batches(rows: DataFrame, batch_size: int = BATCH_SIZE, *, order: str = "id") -> DataFrame:
    """batch, i, seq: full batches of rows in the order of an id; the rest after the last full batch is left out, as the method has it.

    Fewer rows than a batch holds are one batch.
    """
    lines, n = numbered(rows.where(F.col("seq").isNotNull()), order, "seq")
    size = max(1, min(batch_size, n))
    return lines.select(F.floor(F.col("row") / size).cast("bigint").alias("batch"), (F.col("row") % size).cast("int").alias("i"), "seq").where(F.col("batch") < n // size)


def _calibrated(distances: np.ndarray, number: np.ndarray | float, perplexity: float, tolerance: float, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Precision and total of each row's kernel with the entropy of the perplexity, by bisection on the precision, and the weights; all rows at once. number: how often each distance occurs."""
    n, target = len(distances), np.log(perplexity)
    beta, low, high = np.ones(n), np.full(n, -np.inf), np.full(n, np.inf)
    for _ in range(tries + 1):
        used = beta
        weight = number * np.exp(-distances * beta[:, None])
        total = np.maximum(weight.sum(1), EPSILON)
        entropy = np.log(total) + beta * (distances * weight).sum(1) / total
        off = entropy - target
        if (np.abs(off) <= tolerance).all():
            break
        wide, open_ = off > 0, np.abs(off) > tolerance
        low, high = np.where(open_ & wide, beta, low), np.where(open_ & ~wide, beta, high)
        up = np.where(np.isinf(high), beta * 2, (beta + high) / 2)
        down = np.where(np.isinf(low), beta / 2, (beta + low) / 2)
        beta = np.where(open_, np.where(wide, up, down), beta)
    return used, total, weight


def _row_affinities(distances: np.ndarray, perplexity: float, tolerance: float, tries: int) -> np.ndarray:
    """Rows of P with the entropy of the perplexity."""
    _, total, weight = _calibrated(distances, 1.0, perplexity, tolerance, tries)
    return weight / total[:, None]


def _met(rows: DataFrame, *extra: str) -> DataFrame:
    """batch, i, j, d (squared edit distance) and the extra columns of both (the second's with _j) of all pairs i < j of a batch.

    Each part of a batch's rows is joined with the batch, so a batch is spread over tasks and its rows are copied once a part.
    """
    # rows are few but each meets a whole batch: tasks by number of rows, not by bytes
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // 250)
    one = rows.select("batch", (F.col("i") % PARTS).alias("part"), "i", "seq", *extra).repartition(tasks, "batch", "part")
    other = rows.select("batch", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("i").alias("j"), F.col("seq").alias("seq_j"), *[F.col(c).alias(f"{c}_j") for c in extra])
    pairs = one.join(other.repartition(tasks, "batch", "part").hint("merge"), ["batch", "part"]).where("i < j")
    return pairs.select("batch", "i", "j", F.pow(F.levenshtein("seq", "seq_j"), F.lit(2)).cast("double").alias("d"), *extra, *[f"{c}_j" for c in extra])


def joint_affinities(batched: DataFrame, *, perplexity: float = PERPLEXITY, tolerance: float = TOLERANCE, tries: int = TRIES) -> DataFrame:
    """batch, i, j, p: symmetric, summing to 1 in each batch but for the floor at machine epsilon.

    Distances are squared edit distances, computed in the JVM. A row's kernel follows from how often each distance occurs in
    it, so only these numbers are shuffled, never the pairs; with both kernels at hand each pair gives p in either direction.
    """
    from strandmill.plans.storage import Workspace

    space = Workspace(batched.sparkSession, "affinities")
    ends = F.explode(F.array("i", "j")).alias("i")
    often = _met(batched).select("batch", ends, "d").groupBy("batch", "i", "d").agg(F.count(F.lit(1)).alias("n"))
    lists = often.groupBy("batch", "i").agg(F.collect_list("d").alias("d"), F.collect_list("n").alias("n"))

    def run(parts):
        for pdf in parts:
            if len(pdf):
                d, n = np.zeros((2, len(pdf), pdf["d"].map(len).max()))
                for k, (x, y) in enumerate(zip(pdf["d"], pdf["n"])):
                    d[k, : len(x)], n[k, : len(y)] = x, y
                beta, total, weight = _calibrated(d, n, perplexity, tolerance, tries)
                yield pd.DataFrame({"batch": pdf["batch"], "i": pdf["i"], "beta": beta, "total": total, "mass": weight.sum(1) / total})

    kernels = space.save(lists.mapInPandas(run, "batch bigint, i int, beta double, total double, mass double"))
    whole = kernels.groupBy("batch").agg((2 * F.sum("mass")).alias("whole"))
    scaled = kernels.join(whole, "batch").select("batch", "i", "beta", (F.col("total") * F.col("whole")).alias("total"))
    one = lambda c: F.exp(-F.col("d") * F.col(f"beta{c}")) / F.col(f"total{c}")
    pairs = _met(space.save(batched.join(scaled, ["batch", "i"])), "beta", "total").select("batch", "i", "j", F.greatest(one("") + one("_j"), F.lit(EPSILON)).alias("p"))
    ways = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")
    return pairs.select("batch", ways, "p").select("batch", F.col("x.i").alias("i"), F.col("x.j").alias("j"), "p")
