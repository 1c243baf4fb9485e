"""Neighbours by edit distance as equi-joins, and nearest matches of a query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import shift_distance
from strandmill.plans.skew import in_blocks
from strandmill.plans.storage import Workspace


def _bound(size: Column, i: int, k: int) -> Column:
    return F.floor(size * i / k).cast("int")


def part_keys(cutoff: int) -> Column:
    """(part, key of length, part and letters) of the cutoff + 1 parts of `seq`."""
    k, size = cutoff + 1, F.length("seq")
    piece = lambda i: F.substring("seq", _bound(size, i, k) + 1, _bound(size, i + 1, k) - _bound(size, i, k))
    return F.array(*[F.struct(F.lit(i).alias("part"), F.xxhash64(size, F.lit(i), piece(i)).alias("key")) for i in range(k)])


def _moves(cutoff: int, longer: int, i: int) -> range:
    """How far part i of the other string, which is `longer` by so many letters, can have moved here."""
    return range(max(-i, -longer - (cutoff - i)), min(i, -longer + (cutoff - i)) + 1)


def window_keys(cutoff: int) -> Column:
    """(part, key) of all windows of `seq` that can be a part of a string at most `cutoff` edits away.

    Part i, counted from 0, can have moved by i edits before it and by cutoff - i edits after it, whatever the other
    string's length; one part at least is free of edits under that rule.
    """
    k = cutoff + 1
    keys = []
    for longer in range(-cutoff, cutoff + 1):  # the other's length less this one's
        size = F.length("seq") + longer
        for i in range(k):
            for moved in _moves(cutoff, longer, i):
                at, width = _bound(size, i, k) + moved, _bound(size, i + 1, k) - _bound(size, i, k)
                key = F.struct(F.lit(i).alias("part"), F.xxhash64(size, F.lit(i), F.substring("seq", at + 1, width)).alias("key"))
                keys.append(F.when((size >= 0) & (at >= 0) & (at + width <= F.length("seq")), key))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _first_part(a: Column, b: Column, cutoff: int) -> Column:
    """The first part of b that stands in a where so many edits allow it."""
    k, size = cutoff + 1, F.length(b)
    first = F.lit(None).cast("int")
    for i in reversed(range(k)):
        width = _bound(size, i + 1, k) - _bound(size, i, k)
        piece = F.substring(b, _bound(size, i, k) + 1, width)
        there = F.lit(False)
        for longer in range(-cutoff, cutoff + 1):
            for moved in _moves(cutoff, longer, i):
                at = _bound(size, i, k) + moved
                there = there | ((size - F.length(a) == longer) & (at >= 0) & (at + width <= F.length(a)) & (F.substring(a, at + 1, width) == piece))
        first = F.when(there, i).otherwise(first)
    return first


def levenshtein_join(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    """(src, dst, dist) of rows (id, seq) of left and right at most `cutoff` edits apart (inclusive).

    Every right row is keyed by its cutoff + 1 parts, every left row by the windows that such parts can be; what shares a
    key is verified by the exact distance, and each pair is kept where its first part agrees. Null sequences have no neighbours. Meant for distinct sequences.
    """
    l = left.where(F.col("seq").isNotNull()).select(F.col("id").alias("src"), F.col("seq").alias("a"), F.inline(window_keys(cutoff)))  # noqa: E741
    r = right.where(F.col("seq").isNotNull()).select(F.col("id").alias("dst"), F.col("seq").alias("b"), F.inline(part_keys(cutoff)))
    dist = F.levenshtein("a", "b", cutoff)
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part")) & (dist >= 0)
    on = on & (_first_part(F.col("a"), F.col("b"), cutoff) == F.col("l.part"))
    return l.alias("l").join(r.alias("r"), on).select("src", "dst", dist.alias("dist"))


def levenshtein_pairs(rows: DataFrame, cutoff: int) -> DataFrame:
    """(src, dst, dist), src < dst, within one set of rows (id, seq)."""
    return levenshtein_join(rows, rows, cutoff).where(F.col("src") < F.col("dst"))


def one_to_all(rows: DataFrame, target: str | Column) -> DataFrame:
    """Rows with the edit distance of each sequence to one target."""
    return rows.withColumn("dist", F.levenshtein("seq", F.lit(target)))


def nearest(queries: DataFrame, targets: DataFrame, *, mode: str = "exact") -> DataFrame:
    """id, seq, closest_target, mindist of every query row (id, seq): the nearest of all targets (id, seq), the smaller id on ties.

    The distinct query sequences are held against all targets in blocks; each block keeps its best, so only these are
    shuffled. mode 'exact': edit distance; 'shift': distance to the best window of the longer.
    """
    distance = F.levenshtein if mode == "exact" else shift_distance
    space = Workspace(queries.sparkSession, "nearest")
    texts = queries.where(F.col("seq").isNotNull()).select("seq").distinct()
    # copies of a target can't win over their smallest id
    wanted, n = space.save_counted(targets.where(F.col("seq").isNotNull()).groupBy(F.col("seq").alias("t")).agg(F.min("id").alias("t_id")))
    pairs = in_blocks(texts, wanted, by="t", rows=n)
    best = pairs.groupBy("q.seq").agg(F.min(F.struct(distance(F.col("q.seq"), F.col("p.t")).alias("d"), F.col("p.t_id"), F.col("p.t"))).alias("x"))
    return queries.select("id", "seq").join(best, "seq").select("id", "seq", F.col("x.t").alias("closest_target"), F.col("x.d").alias("mindist"))
