"""Counting reads, merging selection rounds, support filter, enrichment ratio and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the support filter and the labels.
MAX_RESIDUES = 20
STRONG, WEAK = 3, 1
LABEL_MARGIN, LABEL_FLOOR = 1e-6, 5e-5


def distinct_lines(lines: DataFrame) -> DataFrame:
    """line_id, seqs, counts of every line once. Lines without line_id are lines of their own if their seqs or counts differ."""
    alone = F.when(F.col("line_id").isNull(), F.struct("seqs", "counts"))
    return lines.select("line_id", "seqs", "counts", alone.alias("alone")).dropDuplicates(["line_id", "alone"]).drop("alone")


def read_counts(reads: DataFrame, seq: str = "seq", *by: str) -> DataFrame:
    """by..., seq, n: how often each stripped read occurs; blank reads count as ''. Null reads are left out."""
    return reads.where(F.col(seq).isNotNull()).groupBy(*by, F.trim(F.col(seq)).alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def round_counts(reads: DataFrame, *, seq: str = "seq", round_: str = "round") -> DataFrame:
    return read_counts(reads, seq, round_)


def long_counts(wide: DataFrame, rounds: list[str], *, seq: str = "seq") -> DataFrame:
    """seq, round, n of a wide table, for counts that were seen: no nulls, NaNs or zeros."""
    long = wide.unpivot([seq], rounds, "round", "n")
    return long.where(F.col("n").isNotNull() & ~F.isnan("n") & (F.col("n") != 0))


def enrichment(counts: DataFrame, rounds: list[str], *, seq: str = "seq", round_: str = "round", n: str = "n") -> DataFrame:
    """seq and a column for each round, 0 where unseen: the full outer merge of all rounds as one aggregation, one shuffle."""
    of = [F.coalesce(F.sum(F.when(F.col(round_) == r, F.col(n))), F.lit(0)).cast("double").alias(r) for r in rounds]
    return counts.where(F.col(round_).isin(rounds)).groupBy(seq).agg(*of)


def latest(rows: DataFrame, key: str, version: str, *values: str) -> DataFrame:
    """key and values of the row with the greatest version; of equal versions the greatest values. Null keys are left out."""
    best = F.max(F.struct(version, *values)).alias("x")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"x.{v}").alias(v) for v in values])


def usable_peptide(seq: Column) -> Column:
    """No stop codon and at most 20 residues."""
    return ~F.contains(seq, F.lit("*")) & (F.length(seq) <= MAX_RESIDUES)


def supported(r1: Column, r2: Column, r3: Column) -> Column:
    """Well seen in one round, or seen in all."""
    return (r3 >= STRONG) | (r2 >= STRONG) | (r1 >= STRONG) | ((r1 >= WEAK) & (r2 >= WEAK) & (r3 >= WEAK))


def enrichment_ratio(before: Column, after: Column) -> Column:
    return F.log10((after + 1) / (before + 1))


def class_label(before: Column, after: Column) -> Column:
    """1 for enriched, 0 for not; what falls between the two rules raises an error (it can't with whole numbers)."""
    gap = F.raise_error("counts between the two label rules").cast("int")
    return F.when(after - before > LABEL_MARGIN, 1).when((after < LABEL_FLOOR) | (after - before < LABEL_MARGIN), 0).otherwise(gap)


def labelled(table: DataFrame) -> DataFrame:
    """seq, r1, r2, r3, ratio, l, l2 of usable, supported sequences: the training classes."""
    filled = table.fillna(0.0, ["r1", "r2", "r3"]).where(usable_peptide(F.col("seq")))
    kept = filled.where(supported(F.col("r1"), F.col("r2"), F.col("r3")))
    label = class_label(F.col("r2"), F.col("r3"))
    return kept.select("seq", "r1", "r2", "r3", enrichment_ratio(F.col("r2"), F.col("r3")).alias("ratio"), label.alias("l")).withColumn("l2", 1 - F.col("l"))


def positive_in_either(table: DataFrame, before: str, after: str) -> DataFrame:
    return table.where((F.col(before) != 0) | (F.col(after) != 0))


def with_group_size(rows: DataFrame, group: str) -> DataFrame:
    """group_size on each row, by an aggregate that is combined before the shuffle and joined back."""
    from strandmill.plans.skew import lookup

    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("group_size"))
    return lookup(rows.drop("group_size"), sizes, group, how="left")
