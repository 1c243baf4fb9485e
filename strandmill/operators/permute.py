"""Random variants of seeds with the distances that seeds of their length really have."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import RESIDUES
from strandmill.operators.affinity import numbered


def paired(seeds: DataFrame, proposals: DataFrame) -> DataFrame:
    """seed, proposal of two tables (id, seq): rows of the same number in the order of their ids, whatever their distance.

    Where there are more seeds than proposals, the proposals start over, so every seed has one.
    """
    (one, _), (other, n) = (numbered(t.where(F.col("seq").isNotNull()), "id", "seq") for t in (seeds, proposals))
    other = other.withColumnRenamed("seq", "proposal")
    return one.select((F.col("row") % max(1, n)).alias("row"), F.col("seq").alias("seed")).join(other, "row").select("seed", "proposal")


def distance_summary(pairs: DataFrame) -> DataFrame:
    """length, dist, n of pairs (seed, proposal): how often each distance occurs for each length of the seed. A histogram, so its size doesn't grow with the pairs."""
    return pairs.where(F.col("seed").isNotNull() & F.col("proposal").isNotNull()).groupBy(F.length("seed").alias("length"), F.levenshtein("seed", "proposal").alias("dist")).agg(F.count(F.lit(1)).alias("n"))


def permuted(seeds: DataFrame, summary: DataFrame, *, trials: int = 1, seed: int = 1, alphabet: str = RESIDUES) -> DataFrame:
    """id, seq, trial, changes, permuted: each seed with a drawn number of positions set to another letter.

    The number is drawn from the summary of the seed's length and cut at that length. All draws follow from id, trial and
    seed, so results don't depend on partitions. Seeds of a length without distances stay as they are.
    """
    by_length = summary.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("dist", "n"))).alias("known"))
    tasks = seeds.select("id", "seq").where(F.length("seq") > 0).withColumn("length", F.length("seq")).join(by_length, "length", "left")
    tasks = tasks.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("state", F.xxhash64("id", "trial", F.lit(seed)))

    def run(batches):
        for pdf in batches:
            changes, out = [], []
            for text, known, state in zip(pdf["seq"], pdf["known"], pdf["state"]):
                rng = np.random.default_rng(int(state) & (2**64 - 1))
                known = known if known is not None else []
                dists, n = [x["dist"] for x in known], np.array([x["n"] for x in known], dtype=float)
                k = min(int(rng.choice(dists, p=n / n.sum())), len(text)) if dists else 0
                letters = list(text)
                for at in rng.choice(len(text), k, replace=False):
                    others = [a for a in alphabet if a != letters[at]]
                    letters[at] = others[rng.integers(len(others))]
                changes.append(k)
                out.append("".join(letters))
            yield pd.DataFrame({"id": pdf["id"], "seq": pdf["seq"], "trial": pdf["trial"], "changes": changes, "permuted": out})

    kind = seeds.schema["id"].dataType.simpleString()
    return tasks.select("id", "seq", "trial", "known", "state").mapInPandas(run, f"id {kind}, seq string, trial int, changes int, permuted string")
