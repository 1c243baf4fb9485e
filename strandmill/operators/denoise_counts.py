"""Background removal from round counts with a mixture of Poisson components."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.plans.storage import Workspace

TRIALS, MAX_COMPONENTS, STEPS = 10, 4, 100


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """value, n: all that a mixture of counts depends on. At most the root of twice the sum of counts rows."""
    return counts.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) >= 0)).groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _passes(most: int) -> tuple[list[list[Column | str]], list[Column]]:
    """The columns of one step, from (value, n, trial, m, w) to the shares e, and its sums for up to `most` components. They hold no numbers of a step, so they are built once."""
    logp = F.zip_with("m", "w", lambda m, w: F.log(w) + F.col("value") * F.log(m) - m).alias("logp")
    selects = [
        ["trial", "value", "n", logp],
        ["trial", "value", "n", F.array_max("logp").alias("top"), "logp"],
        ["trial", "value", "n", "top", F.transform("logp", lambda x: F.exp(x - F.col("top"))).alias("e")],
        ["trial", "value", "n", "top", "e", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("whole")],
    ]
    share = lambda k: F.get("e", F.lit(k)) / F.col("whole") * F.col("n")
    sums = [x for k in range(most) for x in (F.sum(share(k)).alias(f"size_{k}"), F.sum(share(k) * F.col("value")).alias(f"mass_{k}"))]
    return selects, [F.sum((F.col("top") + F.log("whole")) * F.col("n")).alias("total"), *sums]


def _step(hist: DataFrame, trials: dict[int, tuple[list[float], list[float]]], passes: tuple[list[list[Column | str]], list[Column]]) -> dict[int, tuple[float, list[float], list[float]]]:
    """One step of expectation and maximisation for all trials at once: {trial: (log likelihood before the step but for the factorials, means, weights)}."""
    tried = json.dumps([{"trial": t, "m": means, "w": weights} for t, (means, weights) in trials.items()])  # one literal, however many trials
    rows = hist.select("value", "n", F.inline(F.from_json(F.lit(tried), "array<struct<trial: int, m: array<double>, w: array<double>>>")))
    selects, sums = passes
    for columns in selects:
        rows = rows.select(*columns)
    out = {}
    for r in rows.groupBy("trial").agg(*sums).collect():  # one row for each trial
        size = [max(r[f"size_{k}"], 1e-9) for k in range(len(trials[r["trial"]][0]))]
        out[r["trial"]] = (r["total"], [max(r[f"mass_{k}"] / s, 1e-6) for k, s in enumerate(size)], [s / sum(size) for s in size])
    return out


def mixtures(counts: DataFrame, column: str, *, max_components: int = MAX_COMPONENTS, trials: int = TRIALS, seed: int = 1) -> DataFrame:
    """components, score, means, weights: the best of several seeded trials for each number of components.

    The histogram of counts is a table; each step is one aggregate of it for all trials that still move, and the driver
    holds the trials' means and weights only. Trials start at seeded quantiles. score: log likelihood, without the factorials that are the same for all, less half the parameters times log rows.
    """
    spark = counts.sparkSession
    hist = Workspace(spark, "mixture").save(histogram(counts, column))
    rng = np.random.default_rng(seed)
    wanted = [c for c in range(1, max_components + 1) for _ in range(trials if c > 1 else 1)]
    points = [sorted(rng.uniform(0.01, 0.99, c).tolist()) for c in wanted]
    usable = counts.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) >= 0))
    row = usable.select(F.percentile_approx(F.col(column), [p for ps in points for p in ps], 10_000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return spark.createDataFrame([], "components int, score double, means array<double>, weights array<double>")
    starts = iter(row["q"])
    live = {t: ([float(next(starts)) + float(rng.uniform(0.1, 1.0)) for _ in ps], [1 / len(ps)] * len(ps)) for t, ps in enumerate(points)}
    last, done, passes = {}, {}, _passes(max_components)
    for _ in range(STEPS):
        after = _step(hist, live, passes)
        for t, (total, means, weights) in after.items():
            done[t] = (total, *live[t])
            live[t] = (means, weights)
            if t in last and total - last[t] < 1e-5 * abs(total):
                del live[t]
            last[t] = total
        if not live:
            break
    best: dict[int, tuple] = {}
    for t, (total, means, weights) in done.items():
        c = len(means)
        score = total - 0.5 * (2 * c - 1) * math.log(max(row["n"], 2))
        if c not in best or score > best[c][0]:
            order = np.argsort(means)
            best[c] = (score, [float(means[k]) for k in order], [float(weights[k]) for k in order])
    return spark.createDataFrame([(c, *x) for c, x in sorted(best.items())], "components int, score double, means array<double>, weights array<double>")


def component_of(value: Column, means: list[float], weights: list[float]) -> Column:
    """Place of the likeliest component; the logarithm of the factorial is the same for all."""
    score = [F.struct((F.lit(math.log(w)) + value * math.log(m) - m).alias("s"), F.lit(-i).alias("i")) for i, (m, w) in enumerate(zip(means, weights))]
    return -F.greatest(*score)["i"] if len(score) > 1 else F.lit(0)


def denoise(counts: DataFrame, column: str, means: list[float], weights: list[float], *, out: str | None = None) -> DataFrame:
    """Counts of the component of least mean become 0; others lose their component's mean, rounded half to even, not below 0."""
    value = F.col(column)
    place = component_of(value, means, weights)
    mean_of = F.element_at(F.array(*[F.lit(float(m)) for m in means]), place + 1)
    clean = F.when(place == int(np.argmin(means)), 0.0).otherwise(F.greatest(F.rint(value - mean_of), F.lit(0.0)))
    return counts.withColumn(out or column, clean)


def stats(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """nonzero_before, nonzero_after."""
    return before.agg(F.count_if(F.col(column) != 0).alias("nonzero_before")).crossJoin(after.agg(F.count_if(F.col(column) != 0).alias("nonzero_after")))
