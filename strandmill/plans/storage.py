"""Tables written to the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset on a single machine (tests, local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Workspace:
    """Numbered tables of one run of an iterative operator, below a folder of its own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._next = 0

    def save(self, df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
        """Write df and return it as read back: the plan starts anew at the files."""
        path = f"{self.root}/{self._next:05d}"
        self._next += 1
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        back._strandmill_path = path
        return back

    def save_counted(self, df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
        """The same, and the number of rows, or of those where `of` is true, from the written files.

        An Observation would spare the small job, but once a session has one, closures of MLlib can't be sent to tasks any more.
        """
        back = self.save(df)
        return back, (back if of is None else back.where(of)).count()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace that nothing needs any more."""
        for df in tables:
            path = getattr(df, "_strandmill_path", None)
            if path and path.startswith(self.root):
                Files(self.spark).delete(path)


class Files:
    """Small files and folders next to the tables, on whatever file system the cluster has."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        """What lies in a folder, by name; nothing if there is no such folder."""
        fs, p = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written aside, then renamed, so that nobody reads half of it."""
        fs, p = self._at(path)
        _, aside = self._at(f"{path}.part")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.delete(p, False)
        fs.rename(aside, p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
