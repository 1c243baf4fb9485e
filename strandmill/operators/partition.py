"""Dividing groups over parts of given sizes, without parting a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.plans.skew import SALTS, lookup, salt
from strandmill.plans.storage import Workspace

#: Groups with more than this share of all rows are placed one by one; there are at most 1 / GRAIN of them, whatever the table.
GRAIN = 1 / 2000
LINE_GROUPS = 1_000_000  # groups that one task puts in line


def part_targets(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Rows of each part: int(total * ratio), the last gets the rest."""
    names = list(ratios)
    targets = {n: int(total * ratios[n]) for n in names[:-1]}
    return targets | {names[-1]: total - sum(targets.values())}


def match_large(sizes: list[tuple[object, int]], targets: dict[str, int]) -> tuple[dict[object, str], dict[str, int]]:
    """The part of each of the large groups (group, size), the largest first to the part that lacks most, and what each part then lacks."""
    lack, out = dict(targets), {}
    for group, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        part = max(lack, key=lambda p: lack[p])
        lack[part] -= size
        out[group] = part
    return out, lack


def partition_groups(rows: DataFrame, ratios: dict[str, float], *, group: str = "group", tolerance: float = 0.02) -> DataFrame:
    """group, group_size, part of each group; null groups are left out.

    Parts have int(total * ratio) rows, the last the rest, within `tolerance` of the smallest part; an error says so if the
    groups are too large for that. Groups above the grain are matched to parts one by one. The others stand in one
    line, in the order of a hash; what the parts still lack divides the line, and a group belongs where its middle lies, so a
    part is off by less than a grain. Places in the line are running sums of sums, so no task sees all groups.
    """
    space = Workspace(rows.sparkSession, "partition")
    groups, n_groups = space.save_counted(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("group_size")))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    targets = part_targets(total, ratios)
    is_large = F.col("group_size") > total * GRAIN
    large, lack = match_large([(r[0], r[1]) for r in groups.where(is_large).select(group, "group_size").collect()], targets)
    line = groups.where(~is_large).withColumn("s", salt(F.col(group), n=max(SALTS, n_groups // LINE_GROUPS)))
    before_s = line.groupBy("s").agg(F.sum("group_size").alias("rows"))  # one row for each stretch of the line
    before_s = before_s.select("s", (F.sum("rows").over(W.orderBy("s")) - F.col("rows")).alias("before"))
    inside = F.sum("group_size").over(W.partitionBy("s").orderBy(F.xxhash64(group, F.lit(1)), group).rowsBetween(W.unboundedPreceding, 0))
    middle = F.col("before") + inside - F.col("group_size") / 2
    part, stop = F.lit(next(reversed(ratios))), sum(max(0, n) for n in lack.values())
    for name in reversed(lack):  # from the last part to the first: the first whose end lies beyond the middle counts
        part = F.when(middle < stop, name).otherwise(part)
        stop -= max(0, lack[name])
    placed = line.join(F.broadcast(before_s), "s").withColumn("part", part).select(group, "group_size", "part")  # as many rows as stretches
    if large:
        kind = rows.schema[group].dataType
        spark = rows.sparkSession
        known = spark.createDataFrame([(str(g), p) for g, p in large.items()], "group string, part string").select(F.col("group").cast(kind).alias(group), "part")
        placed = placed.unionByName(groups.where(is_large).join(F.broadcast(known), group).select(group, "group_size", "part"))  # at most 1 / GRAIN rows
    placed = space.save(placed)
    got = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("group_size").alias("n")).collect()}
    allowed = tolerance * min(targets.values(), default=0) + 1
    if any(abs(got.get(p, 0) - n) > allowed for p, n in targets.items()):
        raise ValueError(f"no division of the groups into {targets} within {allowed:.0f} rows: {got}")
    return placed


def expand(parts: DataFrame, rows: DataFrame, group: str = "group") -> DataFrame:
    """Rows with the part of their group."""
    return lookup(rows, parts.select(group, "part"), group)


def partition_check(placed: DataFrame, rows: DataFrame, ratios: dict[str, float], *, group: str = "group", tolerance: float = 0.02) -> DataFrame:
    """part, target, within, n_parted: the wanted rows of each part, whether it has them within the tolerance, and groups that stand in several parts."""
    total = rows.where(F.col(group).isNotNull()).count()
    targets = part_targets(total, ratios)
    wanted = rows.sparkSession.createDataFrame(list(targets.items()), "part string, target bigint")
    got = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parted = placed.groupBy(group).agg(F.min("part").alias("a"), F.max("part").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n_parted"))
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("target")) <= tolerance * min(targets.values()) + 1
    return wanted.join(got, "part", "left").crossJoin(F.broadcast(parted)).select("part", "target", near.alias("within"), "n_parted")
