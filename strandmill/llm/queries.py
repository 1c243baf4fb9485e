"""Queries of the problems for the driver, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import density_clusters, grouped_splits, heavy_hitters, linked_groups, mixing, personal, split_overlap, term_counts, tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = term_counts.count_in_deliveries(table(spark, sf_dir, "enrichment"), key="seq", version="loaded_at", fields=["r1", "r2", "r3"])
    return counts.table().withColumn("term", F.col("term").cast("bigint"))  # the counts r1, r2, r3 are whole numbers


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return _terms(spark, sf_dir).select("term", F.explode(flags).alias("flag"))


def p1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.frequent_sequences(table(spark, sf_dir, "cluster_input")).select("kind", "seq")


def p2_top_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.top_sequences(table(spark, sf_dir, "cluster_input"), 100)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups.linked_groups(table(spark, sf_dir, "helper_nb"), table(spark, sf_dir, "helper_seq2group"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.related_rows(grouped_splits.assign_splits(table(spark, sf_dir, "cluster_partition")))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.assign_splits(table(spark, sf_dir, "cluster_partition")).select("row_id", "split")


def p4_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.split_report(grouped_splits.assign_splits(table(spark, sf_dir, "cluster_partition")))


def p4_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.split_check(grouped_splits.assign_splits(table(spark, sf_dir, "cluster_partition")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlapping_pairs(table(spark, sf_dir, "knn_train"), table(spark, sf_dir, "knn_test"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.coverage(table(spark, sf_dir, "knn_train"), table(spark, sf_dir, "knn_test"))


def p5_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = split_overlap.overlap_report(table(spark, sf_dir, "knn_train"), table(spark, sf_dir, "knn_test"))
    return report.withColumn("mean_covered", F.round("mean_covered", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters.centred_clusters(table(spark, sf_dir, "cal_feat"))


def p6_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters.DensityClusters(table(spark, sf_dir, "cal_feat")).features.select("seq_id", "rho", "delta")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters.DensityClusters(table(spark, sf_dir, "cal_feat")).described().select("centre_id", "seq_len", "n_members", "medoid_id", F.round("mean_dist", 6).alias("mean_dist"))


def p6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters.DensityClusters(table(spark, sf_dir, "cal_feat")).merged()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way there and back: the texts that the ids of all documents stand for."""
    return tokens.decoded(tokens.token_ids(table(spark, sf_dir, "documents")))


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).uses()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).check()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), table(spark, sf_dir, "pii_types"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
