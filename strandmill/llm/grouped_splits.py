"""Problem 4: train, validation and test splits that never part related records."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.linked_groups import boruvka
from strandmill.plans.skew import SALTS, lookup, salt
from strandmill.plans.storage import Workspace

#: Donor ids that stand for a missing one, and the shares of the splits.
MISSING_DONORS = ("NA", "UNKNOWN", "NONE")
TARGETS = {"train": 0.8, "valid": 0.1, "test": 0.1}
#: Blocks that one task ranks; the number of parts grows with the number of blocks.
RANKED_BLOCKS = 1_000_000
#: Distinct weights that one task balances.
DIFFERENCED_WEIGHTS = 20_000


def donor_key(donor: Column) -> Column:
    """Letters and digits in upper case; null where that says nothing."""
    key = F.regexp_replace(F.upper(donor), r"[^\p{L}\p{N}]", "")
    return F.when((key != "") & ~key.isin(*MISSING_DONORS), key)


def blocks_of(rows: DataFrame) -> DataFrame:
    """(row_id, block_id) of every row_id: rows with the same group_id above 0 or the same donor are one block, directly or indirectly.

    Groups and donors are named by their smallest row_id. A row in both links the two names, and only these links, each
    once, go to the components: a group or donor with a third of all rows is one node there. Names that are equal belong to
    the same row, so to the same block. block_id is the block's smallest row_id, the row_id itself where nothing is shared.
    Null row_ids give no row; repeated rows are one.
    """
    space = Workspace(rows.sparkSession, "blocks")
    keyed, n = space.save_counted(rows.where(F.col("row_id").isNotNull()).select("row_id", F.when(F.col("group_id") > 0, F.col("group_id")).alias("g"), donor_key(F.col("donor_id")).alias("d")).distinct())
    named = keyed
    for key in ("g", "d"):
        names = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("row_id").alias(f"by_{key}"))
        named = lookup(named, names, key, how="left", rows=n)
    low, high = F.coalesce(F.least("by_g", "by_d"), "row_id"), F.coalesce(F.greatest("by_g", "by_d"), "row_id")
    named = space.save(named.select("row_id", low.alias("low"), high.alias("high")))
    ids = space.save(named.groupBy("row_id").agg(F.min("low").alias("up"), F.max("low").alias("other")))
    several = ids.where(F.col("up") != F.col("other")).select("row_id", "up")  # a row_id with several groups or donors
    links = named.where(F.col("low") != F.col("high")).select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(named.join(several, "row_id").select(F.col("up").alias("src"), F.col("low").alias("dst")))
    labels = boruvka(links.distinct()).select(F.col("id").alias("up"), F.col("label").alias("top"))
    return lookup(ids.select("row_id", "up"), labels, "up", how="left", rows=n).select("row_id", F.coalesce("top", "up").alias("block_id"))


def differenced(vectors: list[np.ndarray], n_bins: int) -> list[np.ndarray]:
    """Largest differencing into n_bins: the bin of each slot of each vector.

    A vector holds n_bins sums. The two with the widest spread are combined again and again, the largest sums of one with
    the smallest of the other, until one is left. Ties go to the earlier vector.
    """
    nodes: list[tuple] = []  # (left, right, order of the slots)
    heap = []
    for k, v in enumerate(vectors):
        order = np.argsort(-v, kind="stable")
        nodes.append((None, k, order))
        heap.append((-int(v.max() - v.min()), k, v[order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, sa = heapq.heappop(heap)
        _, b, sb = heapq.heappop(heap)
        both = sa + sb[::-1]
        order = np.argsort(-both, kind="stable")
        nodes.append((a, b, order))
        both = both[order]
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(nodes) - 1, both))
    out: list[np.ndarray] = [np.arange(n_bins)] * len(vectors)
    todo = [(heap[0][1], np.arange(n_bins))] if heap else []
    while todo:
        k, bins = todo.pop()
        left, right, order = nodes[k]
        place = np.empty(n_bins, dtype=np.int64)
        place[order] = bins  # bin of each slot before it was ordered
        if left is None:
            out[right] = place
        else:
            todo.append((left, place))
            todo.append((right, place[::-1]))
    return out


def _of_weight(weight: int, n: int, n_bins: int) -> np.ndarray:
    sums = np.zeros(n_bins, dtype=np.int64)
    sums[:n] = weight
    return sums


def bins_to_splits(bins: list[tuple[int, int]], targets: dict[str, float]) -> dict[int, str]:
    """Whole bins, the heaviest first, go to the split that lacks most rows."""
    whole, shares = sum(w for _, w in bins), sum(targets.values())
    lack = {s: whole * t / shares for s, t in targets.items()}
    out = {}
    for b, w in sorted(bins, key=lambda x: (-x[1], x[0])):
        split = max(lack, key=lambda s: lack[s])
        lack[split] -= w
        out[b] = split
    return out


def assign_splits(rows: DataFrame, *, targets: dict[str, float] | None = None, n_bins: int = 200) -> DataFrame:
    """(row_id, block_id, weight, bin, split) of every row once; blocks are never parted, weight is the block's number of rows.

    Blocks of equal weight fill all bins evenly as far as their number allows, by a rank that is computed in parts; only
    the rest, fewer than n_bins blocks of each weight, need balancing by differencing. That runs in tasks of at most
    about DIFFERENCED_WEIGHTS weights each; the driver combines what the tasks are left with, one vector of bins each.
    """
    targets = targets or TARGETS
    space = Workspace(rows.sparkSession, "splits")
    placed = space.save(blocks_of(rows))
    blocks, n_blocks = space.save_counted(placed.groupBy("block_id").agg(F.count(F.lit(1)).alias("weight")))
    classes, n_weights = space.save_counted(blocks.groupBy("weight").agg(F.count(F.lit(1)).alias("n")))
    tasks = max(1, -(-n_weights // DIFFERENCED_WEIGHTS))
    rest = classes.select("weight", (F.col("n") % n_bins).cast("int").alias("n"), F.pmod(F.xxhash64("weight"), F.lit(tasks)).cast("int").alias("task")).where("n > 0")

    def balance(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("weight", ascending=False)
        vectors = [_of_weight(w, n, n_bins) for w, n in zip(pdf["weight"], pdf["n"])]
        bins = differenced(vectors, n_bins)
        sums = np.zeros(n_bins, dtype=np.int64)
        for v, b in zip(vectors, bins):
            sums[b] += v
        lists = [b[:n].tolist() for b, n in zip(bins, pdf["n"])]
        # the row without weight holds the sums of the task's bins
        return pd.DataFrame({"task": key[0], "weight": pd.array([*pdf["weight"], None], dtype="Int64"), "bins": [*lists, sums.tolist()]})

    balanced = space.save(rest.groupBy("task").applyInPandas(balance, "task int, weight bigint, bins array<bigint>"))
    left = balanced.where(F.col("weight").isNull()).orderBy("task").collect()  # one vector for each task
    places = differenced([np.array(r["bins"], dtype=np.int64) for r in left], n_bins)
    full = classes.agg(F.coalesce(F.sum(F.col("weight") * F.floor(F.col("n") / n_bins)), F.lit(0)).cast("bigint")).first()[0]
    sums = np.full(n_bins, full, dtype=np.int64)
    for r, place in zip(left, places):
        sums[place] += np.array(r["bins"], dtype=np.int64)
    splits = bins_to_splits(list(enumerate(sums.tolist())), targets)

    blocks = blocks.withColumn("s", salt(F.col("block_id"), n=max(SALTS, n_blocks // RANKED_BLOCKS)))
    parts = blocks.groupBy("weight", "s").agg(F.count(F.lit(1)).alias("n"))
    of_weight = W.partitionBy("weight")
    parts = parts.select("weight", "s", (F.sum("n").over(of_weight.orderBy("s")) - F.col("n")).alias("before"), F.sum("n").over(of_weight).alias("m"))
    ranked = blocks.withColumn("r", F.row_number().over(W.partitionBy("weight", "s").orderBy("block_id"))).join(parts, ["weight", "s"])
    whole = F.floor(F.col("m") / n_bins) * n_bins
    ranked = space.save(ranked.select("block_id", "weight", (F.col("before") + F.col("r") - 1).alias("rank"), whole.alias("whole")))
    even = ranked.where(F.col("rank") < F.col("whole")).select("block_id", "weight", (F.col("rank") % n_bins).cast("int").alias("bin"))
    # fewer than n_bins blocks of a weight are left, so no weight is hot here
    place_of = F.create_map(*[x for r, p in zip(left, places) for x in (F.lit(r["task"]), F.array(*[F.lit(int(b)) for b in p]))]) if left else F.create_map().cast("map<int,array<int>>")
    uneven = ranked.where(F.col("rank") >= F.col("whole")).join(balanced.where(F.col("weight").isNotNull()), "weight")
    uneven = uneven.select("block_id", "weight", F.get(place_of[F.col("task")], F.get("bins", (F.col("rank") - F.col("whole")).cast("int")).cast("int")).alias("bin"))
    split_of = F.create_map(*[x for b, s in splits.items() for x in (F.lit(b), F.lit(s))])
    binned = even.unionByName(uneven).withColumn("split", split_of[F.col("bin")])
    return lookup(placed, binned, "block_id").select("row_id", "block_id", "weight", "bin", "split")


def related_rows(splits: DataFrame) -> DataFrame:
    """(row_id, block_id) of every row that belongs with another one."""
    return splits.where(F.col("weight") > 1).select("row_id", "block_id")


def split_check(splits: DataFrame, *, targets: dict[str, float] | None = None, tolerance: float = 0.01) -> DataFrame:
    """n_rows, n_repeated, n_parted, n_off: rows, row_ids that come more than once, blocks in more than one split, splits whose share is off by more than the tolerance."""
    by_row = splits.groupBy("row_id").count().agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("count") > 1).alias("n_repeated"))
    ends = splits.groupBy("block_id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    parted = ends.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_parted"))
    off = split_report(splits, targets=targets).agg(F.count_if(F.abs(F.col("actual_share") - F.col("target_share")) > tolerance).alias("n_off"))
    return by_row.crossJoin(F.broadcast(parted)).crossJoin(F.broadcast(off))  # one row each


def split_report(splits: DataFrame, *, targets: dict[str, float] | None = None) -> DataFrame:
    """split, target_share, n_rows, actual_share, n_blocks."""
    targets = targets or TARGETS
    whole = sum(targets.values())
    wanted = splits.sparkSession.createDataFrame([(s, t / whole) for s, t in targets.items()], "split string, target_share double")
    counts = splits.groupBy("split", "block_id").count().groupBy("split").agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_blocks"))
    got = wanted.join(counts, "split", "left").fillna(0, ["n_rows", "n_blocks"])
    return got.withColumn("actual_share", F.col("n_rows") / F.greatest(F.sum("n_rows").over(W.partitionBy()), F.lit(1)))

