"""Clustering by edit distance: seeds, their components, projection of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.operators.counts import with_group_size
from strandmill.operators.neighbors import levenshtein_join, levenshtein_pairs
from strandmill.plans.components import components
from strandmill.plans.storage import Workspace

SEEDS = 100_000
CUTOFF = 2


def ranked(rows: DataFrame, n_seeds: int = SEEDS) -> DataFrame:
    """id, seq, count and, for the n_seeds rows with the greatest counts, rank from 1 (ties: smaller id); null rank for the rest.

    The ranking only touches the seeds, whose number is a parameter of the method.
    """
    rows = rows.select("id", "seq", "count")
    top = rows.orderBy(F.desc("count"), "id").limit(n_seeds)
    order = top.select("id", F.row_number().over(W.orderBy(F.desc("count"), "id")).alias("rank"))
    return rows.join(order, "id", "left")


def seed_groups(seeds: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """id, group of each seed (id, seq, rank): the id of the component's best ranked seed."""
    by_rank = seeds.select(F.col("rank").cast("bigint").alias("id"), "seq")
    labels = components(levenshtein_pairs(by_rank, cutoff).select("src", "dst"))
    best = seeds.select(F.col("rank").cast("bigint").alias("label"), F.col("id").alias("group"))
    named = labels.join(best, "label").select(F.col("id").alias("rank"), "group")
    return seeds.withColumn("rank", F.col("rank").cast("bigint")).join(named, "rank", "left").select("id", F.coalesce("group", "id").alias("group"))


def project(rest: DataFrame, seeds: DataFrame, groups: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """id, group of the rows that are no seeds: the most frequent group among neighbouring seeds (ties: smaller group), else their own id."""
    votes = levenshtein_join(rest, seeds, cutoff).join(groups.select(F.col("id").alias("dst"), "group"), "dst").groupBy("src", "group").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("group")).alias("g"))).alias("x")).select(F.col("src").alias("id"), (-F.col("x.g")).alias("group"))
    return rest.select("id").join(won, "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def cluster(rows: DataFrame, *, n_seeds: int = SEEDS, cutoff: int = CUTOFF) -> DataFrame:
    """id, seq, count, group, group_size of rows (id, seq, count) with distinct sequences."""
    space = Workspace(rows.sparkSession, "cluster")
    all_rows = space.save(ranked(rows.where(F.col("seq").isNotNull()), n_seeds))
    seeds, rest = all_rows.where(F.col("rank").isNotNull()), all_rows.where(F.col("rank").isNull())
    groups = space.save(seed_groups(seeds, cutoff))
    every = groups.unionByName(project(rest, seeds, groups, cutoff))
    return with_group_size(all_rows.select("id", "seq", "count").join(space.save(every), "id"), "group")
