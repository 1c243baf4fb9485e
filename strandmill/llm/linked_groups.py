"""Problem 3: one group identifier for all records that are linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.plans.skew import lookup, star_edges
from strandmill.plans.storage import Workspace


def boruvka(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of the edges (src, dst): label is the smallest id of its component.

    Each round every component hooks itself to the other end of its smallest outgoing edge, edges being ordered by (smaller
    end, greater end). So two components can only hook to each other along one edge, where the smaller is the root; the
    trees are collapsed by pointer doubling; edges are relabelled, loops and doubles dropped. Components at least halve
    each round. Every state is a table in the shared folder. The order of edges makes each root the least id of its tree,
    so results are the same in every run.

    Defined results: edges with a null end and loops link nothing; no edges give an empty table; other columns are ignored.
    """
    space = Workspace(edges.sparkSession, "boruvka")
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    live, n = space.save_counted(edges.where(F.col("src") != F.col("dst")).select(lo.alias("src"), hi.alias("dst")).distinct())
    levels: list[DataFrame] = []
    most = 2 * n  # ends of edges
    while n:
        ends = live.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(live.select(F.col("dst").alias("id"), F.col("src").alias("to")))
        hooks = space.save(ends.groupBy("id").agg(F.min("to").alias("up")))  # the smallest edge leads to the smallest neighbour
        roots = _collapse(space, hooks, 2 * n)
        space.drop(hooks)
        levels.append(roots)
        named = lambda end: roots.select(F.col("id").alias(end), F.col("up").alias(f"{end}_up"))
        moved = lookup(live, named("src"), "src", rows=n)
        moved = lookup(moved, named("dst"), "dst", rows=n).select(F.col("src_up").alias("src"), F.col("dst_up").alias("dst"))
        fewer, n = space.save_counted(moved.where(F.col("src") != F.col("dst")).select(lo.alias("src"), hi.alias("dst")).distinct())
        space.drop(live)
        live = fewer
    if not levels:
        return live.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    labels = levels[-1]
    for level in reversed(levels[:-1]):  # the last levels are the small ones
        labels = space.save(lookup(level, labels.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", how="left", rows=most).select("id", F.coalesce("top", "up").alias("up")))
    return labels.select("id", F.col("up").alias("label"))


def _collapse(space: Workspace, hooks: DataFrame, rows: int) -> DataFrame:
    """Pointer doubling until every id points to its root. rows: no more than so many hooks."""
    up_of = lambda t: t.select(F.col("id").alias("up"), F.col("up").alias("top"))
    # two that hook to each other: the smaller becomes the root
    paired = lookup(hooks, up_of(hooks), "up", rows=rows)
    table = space.save(paired.select("id", F.when((F.col("top") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up")))
    while True:
        jumped = lookup(table, up_of(table), "up", rows=rows)
        after, moved = space.save_counted(jumped.select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), F.col("moved"))
        space.drop(table)
        table = after.select("id", "up")
        table._strandmill_path = after._strandmill_path
        if not moved:
            return table


def close_pairs(pairs: DataFrame, *, max_dist: int) -> DataFrame:
    """(src, dst), smaller first, of unordered pairs whose latest row with a distance has at most max_dist.

    Of rows measured at the same time the smallest distance counts; rows without time are the oldest.
    """
    whole = pairs.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("dist").isNotNull() & (F.col("src") != F.col("dst")))
    return (
        whole.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.max(F.struct("measured_at", (-F.col("dist")).alias("near"))).alias("last"))
        .where(-F.col("last.near") <= max_dist)
        .select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    )


def linked_groups(pairs: DataFrame, earlier: DataFrame, *, max_dist: int = 2) -> DataFrame:
    """(seq_id, group_id) of every record of `earlier` that is linked to another one.

    Links: close pairs of two known records, and equal non-null earlier group_id. Records without any link, null ids and
    pairs with unknown ends give no row.
    """
    known = earlier.select("seq_id", "group_id").where(F.col("seq_id").isNotNull()).distinct()
    ids = known.select("seq_id").distinct()
    near, n = Workspace(pairs.sparkSession, "links").save_counted(close_pairs(pairs, max_dist=max_dist))
    for end in ("src", "dst"):
        near = lookup(near, ids.select(F.col("seq_id").alias(end)), end, rows=n)
    edges = near.select("src", "dst").unionByName(star_edges(known, "seq_id", "group_id"))
    return boruvka(edges).select(F.col("id").alias("seq_id"), F.col("label").alias("group_id"))
