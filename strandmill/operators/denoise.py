"""Telling real DNA reads from errors of their neighbours, by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.stats import noise_probability, noise_probability_any
from strandmill.operators.hamming import hamming_pairs

LEVEL = 0.05


def max_neighbour_counts(rows: DataFrame, dc: int = 4) -> DataFrame:
    """id, seq, n, max_neighbor_cnt_d1 .. d(dc-1): the greatest count among neighbours at exactly each distance, 0 if there is none."""
    pairs = hamming_pairs(rows, dc - 1)
    both = pairs.select("src", "dst", "dist").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    counted = both.join(rows.select(F.col("id").alias("dst"), "n"), "dst")
    best = counted.groupBy(F.col("src").alias("id")).agg(*[F.max(F.when(F.col("dist") == d, F.col("n"))).alias(f"max_neighbor_cnt_d{d}") for d in range(1, dc)])
    return rows.select("id", "seq", "n").join(best, "id", "left").fillna(0, [f"max_neighbor_cnt_d{d}" for d in range(1, dc)])


def noise_probabilities(features: DataFrame, dc: int = 4, *, any_way: bool = False) -> DataFrame:
    """id, seq, n, p1 .. p(dc-1), p_max: chance that the reads are errors of a neighbour at each distance."""
    chance = noise_probability_any if any_way else noise_probability
    p = [chance(F.length("seq"), F.col(f"max_neighbor_cnt_d{d}"), F.lit(d), F.col("n")).alias(f"p{d}") for d in range(1, dc)]
    out = features.select("id", "seq", "n", *p)
    return out.withColumn("p_max", F.greatest(*[f"p{d}" for d in range(1, dc)]) if dc > 2 else F.col("p1"))


def distinct_line_count(lines: DataFrame, line: str = "seqs") -> int:
    """Distinct stripped lines, headers included: the number of tests that the level is divided by."""
    return lines.where(F.col(line).isNotNull()).select(F.trim(line).alias("x")).distinct().count()


def real_reads(probabilities: DataFrame, n_tests: int, *, level: float = LEVEL) -> DataFrame:
    """Rows of which no chance reaches level / n_tests."""
    return probabilities.where(F.col("p_max") < level / n_tests)


def accepted_in_replicates(first: DataFrame, second: DataFrame, *, level: float = LEVEL) -> DataFrame:
    """seq, p1, p2, p: joint chance over two replicates (seq, p), 1 where unseen, at most level / number of sequences in either."""
    both = first.select("seq", F.col("p").alias("p1")).join(second.select("seq", F.col("p").alias("p2")), "seq", "full_outer")
    both = both.select("seq", F.coalesce("p1", F.lit(1.0)).alias("p1"), F.coalesce("p2", F.lit(1.0)).alias("p2")).withColumn("p", F.col("p1") * F.col("p2"))
    whole = both.agg(F.count(F.lit(1)).alias("tests"))
    return both.crossJoin(F.broadcast(whole)).where(F.col("p") <= level / F.col("tests")).drop("tests")
