"""A session with the settings the operators expect; on a cluster its own settings win."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "strandmill", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution splits skewed joins and merges small partitions; ANSI mode stays as Spark has it."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    spark = builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, so that Python tasks find it whatever their working folder; once for each context."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_strandmill_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="strandmill-")) / "strandmill.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._strandmill_shipped = True
