"""Density peaks among equally long sequences: rho, delta, centres and assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.bits import mismatches
from strandmill.operators.hamming import close_to, hamming_pairs, longest, with_planes
from strandmill.plans.skew import in_blocks, lookup
from strandmill.plans.storage import Workspace

#: Mismatches up to which a nearest denser sequence, or centre, is looked for through shared segments; from so many rows on, two segments have to agree.
NEARBY, NEAR_CENTRE, MANY_ROWS = 7, 3, 500_000


def rho_delta(rows: DataFrame, dc: int = 4) -> DataFrame:
    """id, seq, rho, delta of rows (id, seq) with distinct sequences.

    rho: rows of equal length at fewer than dc mismatches, itself included. delta: fewest mismatches to a row of equal length
    with greater rho; the most mismatches to any row of its length where there is none. Pairs within the radius of rho
    settle most rows, shared segments most of the rest. Rows that are left meet only the denser rows of their length in blocks; those of the
    greatest rho of a length, which have no denser one, meet all of it.
    """
    space = Workspace(rows.sparkSession, "density")
    rows = rows.where(F.col("seq").isNotNull()).select("id", F.upper("seq").alias("seq"))
    max_len = longest(rows)
    pairs, n_pairs = space.save_counted(hamming_pairs(rows, dc - 1))
    ends = pairs.select(F.col("src").alias("id"), F.col("dst").alias("other"), "dist").unionByName(pairs.select(F.col("dst").alias("id"), F.col("src").alias("other"), "dist"))
    near = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    dense, n = space.save_counted(with_planes(rows.join(near, "id", "left").select("id", "seq", (F.coalesce("n", F.lit(0)) + 1).alias("rho")), max_len))
    rho = lambda key, name: dense.select(F.col("id").alias(key), F.col("rho").alias(name))
    known = lookup(lookup(ends, rho("id", "own"), "id", rows=2 * n_pairs), rho("other", "others"), "other", rows=2 * n_pairs)
    settled = [space.save(known.where(F.col("others") > F.col("own")).groupBy("id").agg(F.min("dist").alias("delta")))]
    top = dense.groupBy("len").agg(F.max("rho").alias("top"))  # one row for each length
    left = dense.join(settled[0], "id", "left_anti").join(top, "len")
    peaks, left = left.where(F.col("rho") == F.col("top")).drop("top"), space.save(left.where(F.col("rho") < F.col("top")).drop("top"))
    denser = F.col("p.rho") > F.col("q.rho")
    hit = close_to(left, dense, NEARBY, max_len, also=denser, agree=2 if n >= MANY_ROWS else 1)
    settled.append(space.save(hit.groupBy(F.col("q.id").alias("id")).agg(F.min("dist").alias("delta"))))
    left = space.save(left.join(settled[1], "id", "left_anti"))
    dist, same_length = mismatches("q", "p", max_len), F.col("q.len") == F.col("p.len")
    least = left.groupBy("len").agg(F.min("rho").alias("least"))
    able = dense.join(least, "len").where(F.col("rho") > F.col("least")).drop("least")
    met = in_blocks(left, able, by="id", rows=n, on=same_length & denser)
    settled.append(met.groupBy(F.col("q.id").alias("id")).agg(F.min(dist).cast("int").alias("delta")))
    far = in_blocks(space.save(peaks), dense, by="id", rows=n, on=same_length)
    settled.append(far.groupBy(F.col("q.id").alias("id")).agg(F.max(dist).cast("int").alias("delta")))
    return space.save(dense.select("id", "seq", "rho").join(reduce(DataFrame.unionByName, settled), "id"))


def centres(features: DataFrame, *, min_rho: float = 0, min_delta: float = 5, delta_by_length: dict[int, float] | None = None) -> DataFrame:
    """Rows above both cutoffs. delta_by_length has cutoffs for single lengths, min_delta holds for the others. No centre at all is an error where the rows are used, not here."""
    cutoff = F.lit(float(min_delta))
    for n, c in (delta_by_length or {}).items():
        cutoff = F.when(F.length("seq") == n, float(c)).otherwise(cutoff)
    return features.where((F.col("rho") > min_rho) & (F.col("delta") > cutoff))


def assign(features: DataFrame, centre_rows: DataFrame) -> DataFrame:
    """id, centre_id of all rows whose length has a centre: the nearest by mismatches, the smaller id on ties; centres keep their own.

    Centres near a row are found through shared segments; rows without one meet all centres of their length, in blocks.
    """
    space = Workspace(features.sparkSession, "assign")
    max_len = longest(features)
    rows, n = space.save_counted(with_planes(features.select("id", "seq"), max_len))
    middles = space.save(with_planes(centre_rows.select("id", "seq"), max_len))
    nearest = lambda pairs, d: pairs.groupBy(F.col("p.id").alias("id")).agg(F.min(F.struct(d.alias("d"), F.col("q.id").alias("c"))).alias("x"))
    near = space.save(nearest(close_to(middles, rows, NEAR_CENTRE, max_len), F.col("dist")))
    left = rows.join(near, "id", "left_anti")
    far = nearest(in_blocks(middles, left, by="id", rows=n, on=F.col("q.len") == F.col("p.len")), mismatches("q", "p", max_len).cast("int"))
    own = centre_rows.select("id", F.col("id").alias("own"))
    return near.unionByName(far).join(own, "id", "left").select("id", F.coalesce("own", "x.c").alias("centre_id"))
