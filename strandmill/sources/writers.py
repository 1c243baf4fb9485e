"""Writers of the formats that other tools read."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(df: DataFrame, path: str, *, name: str = "read_id", seq: str = "seq", records_per_file: int = 0) -> None:
    writer = df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", records_per_file) if records_per_file else writer).text(path)


def write_fastq(df: DataFrame, path: str, *, name: str = "read_id", seq: str = "seq", qual: str = "qual", packed: bool = True) -> None:
    """Four-line records, gzipped if packed."""
    record = F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))
    df.select(record.alias("value")).write.mode("overwrite").text(path, compression="gzip" if packed else "none")


def write_targets(df: DataFrame, folder: str, *, order: str, columns: list[str], target: str, stem: str = "data") -> None:
    """Line-aligned <stem>.tsv and <stem>.target: both are written in one order, so the files of each, by name, hold the same lines."""
    rows = df.select(F.col(order).alias("_order"), *[F.col(c).cast("string").alias(c) for c in columns], F.col(target).cast("string").alias("_target")).orderBy("_order", *columns, "_target")
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(f"{folder}/{stem}.tsv")
    rows.select(F.col("_target").alias("value")).write.mode("overwrite").text(f"{folder}/{stem}.target")


def write_reads(df: DataFrame, path: str, *, sample: str = "sample", seq: str = "seq") -> None:
    """One sequence a line, a folder for each sample."""
    df.select(sample, F.col(seq).alias("value")).write.mode("overwrite").partitionBy(sample).text(path)


def write_tsv(df: DataFrame, path: str, *, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_counts(df: DataFrame, path: str, *, by: str = "sample") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_parts(df: DataFrame, path: str, *, part: str = "part") -> None:
    """A folder for each named part."""
    df.write.mode("overwrite").partitionBy(part).csv(path, sep="\t", header=True)


def write_assignments(df: DataFrame, path: str, *, ident: str = "id", group: str = "group") -> None:
    """<path>/assign: member and group; <path>/clust: a line for each member, grouped and sorted, so no group is held as one list."""
    df.select(ident, group).write.mode("overwrite").csv(f"{path}/assign", sep="\t")
    df.select(group, ident).repartitionByRange(group, ident).sortWithinPartitions(group, ident).write.mode("overwrite").csv(f"{path}/clust", sep="\t")


def write_run(spark, path: str, command: str, **settings: object) -> None:
    """A row about a finished run: command, settings, time."""
    row = [(command, {k: str(v) for k, v in settings.items()}, time.time())]
    spark.createDataFrame(row, "command string, settings map<string,string>, finished_at double").write.mode("append").json(path)
