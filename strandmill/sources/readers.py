"""Readers of sequencing text formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of tabular alignment output.
HIT_COLUMNS = "qseqid sseqid pident length mismatch gapopen qstart qend sstart send evalue bitscore".split()
HIT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType() if c in ("qseqid", "sseqid") else T.DoubleType() if c in ("pident", "evalue", "bitscore") else T.IntegerType()) for c in HIT_COLUMNS]
)


def _sample(path) -> F.Column:
    """File name without folder, up to the first underscore or dot."""
    return F.regexp_extract(path, r"([^/_.]+)[^/]*$", 1)


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """value, path, start (of the split), at: lines of all files of a folder or path."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.input_file_block_start().alias("start")).withColumn("at", F.monotonically_increasing_id())


def _with_line(lines: DataFrame, *, whole: bool = False) -> DataFrame:
    """The same with `line`, from 0 in each file, or over all files in the order of their names: by the counts of the splits, so no task sees more than its split."""
    splits = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    order = W.orderBy("path", "start") if whole else W.partitionBy("path").orderBy("start")  # one row for each split
    before = splits.select("path", "start", "first", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return lines.join(before, ["path", "start"]).withColumn("line", F.col("at") - F.col("first") + F.col("before")).drop("first", "before")


def read_fastq(spark: SparkSession, path: str, glob: str = "*.fastq*") -> DataFrame:
    """sample, read_id, seq, qual of all FASTQ files below a folder. '#' and ':' in ids become '_'; cut last records are left out.

    Compressed files can't be split, so their lines come in order in one task and are framed there as they stream by,
    without a shuffle. Lines of plain files are numbered by the counts of their splits and joined to records by number.
    """
    lines = _lines(spark, path, glob)
    packed = F.col("path").rlike(r"\.(gz|zst|lz4|snappy|deflate)$")

    def frame(batches):
        import pandas as pd

        held: list[str] = []
        last = None
        for pdf in batches:
            rows = []
            for where, line in zip(pdf["path"], pdf["value"]):
                if where != last:
                    held, last = [], where
                held.append(line)
                if len(held) == 4:
                    rows.append((where, held[0], held[1], held[3]))
                    held = []
            yield pd.DataFrame(rows, columns=["path", "read_id", "seq", "qual"])

    framed = lines.where(packed).select("path", "value").mapInPandas(frame, "path string, read_id string, seq string, qual string")
    numbered = _with_line(lines.where(~packed))
    of = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    joined = numbered.groupBy("path", F.floor(F.col("line") / 4).alias("record")).agg(of(0).alias("read_id"), of(1).alias("seq"), of(3).alias("qual")).where(F.col("qual").isNotNull())
    read = framed.unionByName(joined.select("path", "read_id", "seq", "qual"))
    name = F.split(F.substring("read_id", 2, 2**31 - 1), r"\s+")[0]
    return read.select(_sample(F.col("path")).alias("sample"), F.translate(name, "#:", "__").alias("read_id"), F.trim("seq").alias("seq"), F.trim("qual").alias("qual"))


def read_fasta(spark: SparkSession, path: str, glob: str = "*.fa*") -> DataFrame:
    """sample, read_id, seq of FASTA files, wrapped or not; ids up to white space; records without sequence are left out."""
    records = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n>").text(path).select(F.ltrim("value", F.lit("> \r\n")).alias("value"), F.col("_metadata.file_path").alias("path"))
    parts = records.select("path", F.split("value", "\r?\n", 2).alias("p")).where(F.size("p") == 2)
    return parts.select(_sample("path").alias("sample"), F.split(F.col("p")[0], r"\s+")[0].alias("read_id"), F.regexp_replace(F.col("p")[1], r"\s", "").alias("seq")).where(F.length("seq") > 0)


def read_columns(spark: SparkSession, path: str, columns: list[str], *, skip: int = 0) -> DataFrame:
    """Columns of text split at white space; shorter lines have nulls, blank lines are left out, and so are the first `skip` lines of each file."""
    lines = _with_line(_lines(spark, path)).where(F.col("line") >= skip) if skip else spark.read.option("recursiveFileLookup", True).text(path)
    parts = lines.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(*[F.try_element_at("p", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def read_replicates(spark: SparkSession, folder: str, columns: list[str], *, glob: str = "*") -> DataFrame:
    """replicate (name of the folder the file lies in) and the columns of all files below a folder; lines whose first word has a '>' are left out."""
    lines = _lines(spark, folder, glob).select(F.element_at(F.split("path", "/"), -2).alias("replicate"), F.split(F.trim("value"), r"\s+").alias("p"))
    kept = lines.where((F.col("p")[0] != "") & ~F.contains(F.col("p")[0], F.lit(">")))
    return kept.select("replicate", *[F.try_element_at("p", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=HIT_SCHEMA)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, over all files in the order of their names), value."""
    return _with_line(_lines(spark, path), whole=True).select("line", "value")


def read_targets(spark: SparkSession, folder: str, *, stem: str = "data", seq_column: int = 0) -> DataFrame:
    """row_idx, seq, target (array<double>) of the line-aligned files <stem>.tsv and <stem>.target. Lines without partner are left out."""
    data = read_numbered(spark, f"{folder}/{stem}.tsv").select("line", F.split("value", r"\s+")[seq_column].alias("seq"))
    target = read_numbered(spark, f"{folder}/{stem}.target").select("line", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("target"))
    return data.join(target, "line").withColumnRenamed("line", "row_idx")


def read_settings(path: str) -> list[tuple[str, ...]]:
    """Rows of a small parameter file (round pairs, component counts, cutoffs, replicates)."""
    with open(path, encoding="utf-8") as f:
        return [tuple(line.split()) for line in f if line.strip()]
