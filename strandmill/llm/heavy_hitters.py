"""Problem 2: the most frequent items of a very long column, exactly and in bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import clean_sequence, is_header


def distinct_lines(lines: DataFrame) -> DataFrame:
    """seq (clean), reads of each line once: repeated deliveries of a line_id are one line.

    Lines without line_id are lines of their own if their clean sequence or reads differ; header lines and lines whose clean
    sequence is empty or null are left out; counts that are null, NaN, infinite, zero or negative are 0 reads.
    """
    usable = ~F.isnan("counts") & (F.col("counts") > 0) & (F.col("counts") < float("inf"))
    kept = lines.where(~is_header(F.col("seqs"))).select("line_id", clean_sequence(F.col("seqs")).alias("seq"), F.when(usable, F.col("counts")).otherwise(0.0).alias("reads"))
    alone = F.when(F.col("line_id").isNull(), F.struct("seq", "reads"))
    return kept.where(F.length("seq") > 0).groupBy("line_id", alone.alias("alone")).agg(F.min(F.struct("seq", "reads")).alias("x")).select("x.seq", "x.reads")


def item_totals(items: DataFrame, item: str, weight: str) -> DataFrame:
    """seq, n_rows, n_reads of every distinct item: combined on the map side, hash partitions spill to disk."""
    totals = items.groupBy(F.col(item).alias("seq")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(weight).alias("n_reads"))
    return totals.where((F.col("n_rows") > 0) & F.col("n_reads").isNotNull())  # true of all: every use then needs both, and one shuffle serves all uses


def frequent(totals: DataFrame, measure: str, kind: str, *, min_share: float) -> DataFrame:
    """kind, seq, total, share of the items with at least min_share of the sum of measure.

    At most 1 / min_share items can have such a share, so the top of that many is exact: Spark keeps that many rows in each
    partition and orders them once more at the end.
    """
    k = int(1 / min_share) + 1
    top = totals.select("seq", F.col(measure).cast("double").alias("total")).orderBy(F.desc("total"), "seq").limit(k)
    whole = totals.agg(F.sum(measure).cast("double").alias("whole"))
    return top.crossJoin(F.broadcast(whole)).where((F.col("total") > 0) & (F.col("total") >= F.col("whole") * min_share)).select(F.lit(kind).alias("kind"), "seq", "total", (F.col("total") / F.col("whole")).alias("share"))


def frequent_sequences(lines: DataFrame, *, min_share: float = 0.002) -> DataFrame:
    """kind ('rows' or 'reads'), seq, total, share. Both kinds use the same shuffles; an empty table gives no rows."""
    totals = item_totals(distinct_lines(lines), "seq", "reads")
    return frequent(totals, "n_rows", "rows", min_share=min_share).unionByName(frequent(totals, "n_reads", "reads", min_share=min_share))


def top_sequences(lines: DataFrame, k: int = 100) -> DataFrame:
    """The k sequences with the most lines: rank, seq, n_rows, n_reads; ties go to the smaller sequence."""
    totals = item_totals(distinct_lines(lines), "seq", "reads")
    return totals.orderBy(F.desc("n_rows"), "seq").limit(k)
