"""Problem 6: clusters of similar sequences by density, with their size and most typical members."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.bits import plane_names
from strandmill.llm.linked_groups import boruvka
from strandmill.operators.hamming import close_to, longest, with_planes
from strandmill.plans.skew import lookup
from strandmill.plans.storage import Workspace

RHO_RADIUS = 3  # rho counts records at fewer than 4 mismatches
DELTA_RADIUS = 8
MANY_ROWS = 500_000  # searched sequences from which on two segments have to agree in the wide search: more, but smaller cells


class DensityClusters:
    """Density features, centres and clusters of records (seq_id, seq, rho, delta, loaded_at).

    Sequences become vectors of segments; a space of records of one length is divided once along each segment, so a record
    lies in radius + 1 overlapping cells and every pair within the radius meets in one of them (operators/hamming.py). In
    each cell the records within the radius of a centre, its core point, are a local cluster; local clusters of different
    cells that share their core point are one, and a record of several clusters belongs to the nearest. All work on
    neighbours is on distinct sequences, with the number of their copies; states that are used again are written tables.

    Defined results: the latest row of a seq_id counts (of equally late ones the greatest); rows without seq_id or seq are
    left out; letter case doesn't matter; an empty table gives no rows.
    """

    def __init__(self, rows: DataFrame, *, min_rho: int = 6, min_delta: int = 6, radius: int = 4) -> None:
        self.space = Workspace(rows.sparkSession, "density")
        self.min_rho, self.min_delta, self.radius = min_rho, min_delta, radius
        last = rows.where(F.col("seq_id").isNotNull()).groupBy("seq_id").agg(F.max(F.struct("loaded_at", F.upper("seq").alias("seq"), F.col("rho").cast("bigint").alias("rho"), F.col("delta").cast("int").alias("delta"))).alias("x"))
        self.records = self.space.save(last.select("seq_id", "x.seq", "x.rho", "x.delta").where(F.col("seq").isNotNull()))
        self.max_len = longest(self.records)

    @cached_property
    def texts(self) -> DataFrame:
        """Distinct sequences with bit planes, copies, the greatest rho and, where a record lacks its rho, the `counted` one."""
        of = self.records.groupBy("seq").agg(F.count(F.lit(1)).alias("copies"), F.max("rho").alias("rho"), F.bool_or(F.col("rho").isNull()).alias("lacks"))
        texts = self.space.save(with_planes(of, self.max_len))
        unknown = texts.where("lacks").select("seq", "len", *plane_names(self.max_len))
        near = close_to(unknown, texts, RHO_RADIUS, self.max_len)
        counted = near.groupBy(F.col("q.seq").alias("seq")).agg(F.sum("p.copies").alias("counted"))
        return self.space.save(texts.drop("lacks").join(counted, "seq", "left").withColumn("rho", F.greatest("rho", "counted")))

    @cached_property
    def features(self) -> DataFrame:
        """seq_id, seq, rho, delta, with nulls worked out from the other rows."""
        texts, bare = self.texts, ["seq", "len", *plane_names(self.max_len)]
        records = lookup(self.records, texts.select("seq", "counted"), "seq").withColumn("rho", F.coalesce("rho", "counted")).drop("counted")
        lacking, n = self.space.save_counted(records.where(F.col("delta").isNull()).select("seq", "rho").distinct().join(texts.select(*bare), "seq"))
        denser = F.col("p.rho") > F.col("q.rho")

        def nearest(q: DataFrame, radius: int, **how: int) -> DataFrame:
            return close_to(q, texts, radius, self.max_len, also=denser, **how).groupBy(F.col("q.seq").alias("seq"), F.col("q.rho").alias("rho")).agg(F.min("dist").alias("nearest"))

        close = self.space.save(nearest(lacking, RHO_RADIUS))  # most are found nearby, through few and small cells
        far = nearest(lacking.join(close, ["seq", "rho"], "left_anti"), DELTA_RADIUS, agree=2 if n >= MANY_ROWS else 1)
        out = records.join(close.unionByName(far), ["seq", "rho"], "left")
        return self.space.save(out.select("seq_id", "seq", "rho", F.coalesce("delta", "nearest", F.length("seq")).cast("int").alias("delta")))

    @cached_property
    def centres(self) -> DataFrame:
        """Qualifying sequences, each by its smallest seq_id, that no other one with a smaller seq_id beats within the radius."""
        dense = self.features.where((F.col("rho") >= self.min_rho) & (F.col("delta") >= self.min_delta))
        able = self.space.save(with_planes(dense.groupBy("seq").agg(F.min("seq_id").alias("seq_id")), self.max_len))
        beaten = close_to(able, able, self.radius, self.max_len, also=F.col("p.seq_id") < F.col("q.seq_id")).select(F.col("q.seq_id").alias("seq_id")).distinct()
        return self.space.save(able.join(beaten, "seq_id", "left_anti"))

    def local_clusters(self) -> DataFrame:
        """cell, centre_id, seq, dist: distinct sequences within the radius of a centre, by the cell in which both lie."""
        return close_to(self.centres, self.texts, self.radius, self.max_len).select("q.cell", F.col("q.seq_id").alias("centre_id"), "p.seq", "dist")

    def members(self) -> DataFrame:
        """seq_id, seq, rho, centre_id, dist of every record of a cluster: local clusters with one core point merged; the nearest centre counts, then the smaller centre_id."""
        best = self.local_clusters().groupBy("seq").agg(F.min(F.struct("dist", "centre_id")).alias("best"))
        return lookup(self.features, best, "seq").select("seq_id", "seq", "rho", "best.centre_id", "best.dist")

    def described(self, *, typical: int = 3) -> DataFrame:
        """centre_id, seq_len, n_members, medoid_id, mean_dist, typical_ids of each cluster.

        The medoid has the least sum of mismatches to all members (ties: smaller seq_id); typical_ids are the best few by
        that sum. The sums follow exactly from the letter counts of each position, so no pair of members is formed.
        """
        members = self.space.save(self.members().select("seq_id", "seq", "centre_id"))
        texts = self.space.save(members.groupBy("centre_id", "seq").agg(F.count(F.lit(1)).alias("copies"), F.min("seq_id").alias("seq_id")))
        letters = texts.select("*", F.posexplode(F.split("seq", "")).alias("pos", "letter"))
        profile = letters.groupBy("centre_id", "pos", "letter").agg(F.sum("copies").alias("same"))
        agreeing = letters.join(profile, ["centre_id", "pos", "letter"]).groupBy("centre_id", "seq").agg(F.sum("same").alias("same"))
        sizes = texts.groupBy("centre_id").agg(F.sum("copies").alias("n_members"), F.max(F.length("seq")).alias("seq_len"))
        scored = texts.join(agreeing, ["centre_id", "seq"]).join(sizes, "centre_id").withColumn("total", F.col("n_members") * F.col("seq_len") - F.col("same"))
        best = scored.withColumn("r", F.row_number().over(W.partitionBy("centre_id").orderBy("total", "seq_id"))).where(F.col("r") <= typical)
        ranked = F.transform(F.array_sort(F.collect_list(F.struct("r", "seq_id"))), lambda x: x["seq_id"])
        return best.groupBy("centre_id", "seq_len", "n_members").agg(
            F.min_by("seq_id", "r").alias("medoid_id"), (F.min("total") / F.max("n_members")).alias("mean_dist"), ranked.alias("typical_ids")
        )

    def merged(self) -> DataFrame:
        """seq_id, cluster_id: clusters that share a dense record are one, whichever centre that record is nearest to.

        Local clusters are the dense records within `radius` of one centre; a dense record within reach of several centres
        joins their clusters, as one of a core point shared by neighbouring cells would. cluster_id is the least centre_id.
        """
        core = self.features.where(F.col("rho") >= self.min_rho).select("seq").distinct()
        reach = self.space.save(self.local_clusters().join(core, "seq", "left_semi").select("seq", "centre_id"))
        shared = reach.withColumn("dst", F.min("centre_id").over(W.partitionBy("seq"))).select(F.col("centre_id").alias("src"), "dst").distinct()
        joined = boruvka(shared).select(F.col("id").alias("centre_id"), F.col("label").alias("cluster_id"))
        return lookup(self.members().select("seq_id", "centre_id"), joined, "centre_id", how="left").select("seq_id", F.coalesce("cluster_id", "centre_id").alias("cluster_id"))


def centred_clusters(rows: DataFrame, **how: int) -> DataFrame:
    """seq_id, centre_id of every record of a cluster, centres included."""
    return DensityClusters(rows, **how).members().select("seq_id", "centre_id")


__all__ = ["DensityClusters", "centred_clusters"]
