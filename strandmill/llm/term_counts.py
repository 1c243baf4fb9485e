"""Problem 1: frequency of every distinct value, kept up to date by signed deltas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.plans.storage import Files, Workspace

BUCKETS = 8


class TermCounts:
    """Persistent counts of terms over a changing set of records, in a folder that later sessions can open again.

    State: a log with the latest version of each record (key, version, terms, deleted), in buckets by a hash of the key, and
    the counts (term, n_occurrences, n_records), in buckets by a hash of the term. `apply` reads the log's buckets of its
    batch's keys only, turns added, changed and deleted records into signed changes by term, aggregates those before any
    shuffle of terms, and rewrites only the buckets of log and counts that have a change. A manifest names the current
    version of every bucket; it is written last, so a broken run leaves the state before it. The row with null term counts
    all terms and all records. One writer at a time.

    Terms are strings; other types are cast. Defined results: rows with null key are left out; of several rows with one key
    the greatest version counts (null is the oldest; of equal versions the greatest terms); a row older than the version
    already counted changes nothing; null terms are no terms; a record without terms is still a record; an empty batch
    changes nothing.
    """

    RECORD = "key string, version timestamp, terms array<string>, deleted boolean, before array<string>, changed boolean, bucket int"
    COUNT = "term string, n_occurrences bigint, n_records bigint, bucket int"

    def __init__(self, spark: SparkSession, folder: str | None = None, *, buckets: int = BUCKETS) -> None:
        """folder: where the state is or shall be; without one it lasts as long as the shared folder. buckets: of a new state; choose them so that one is a block of work for a task or a few."""
        self.spark, self.files = spark, Files(spark)
        self.space = Workspace(spark, "term-counts")
        self.root = folder.rstrip("/") if folder else f"{self.space.root}/state"
        known = [n for n in self.files.names(self.root) if n.startswith("manifest-") and n.endswith(".json")]
        self.state = json.loads(self.files.read(f"{self.root}/{known[-1]}")) if known else {"version": 0, "buckets": buckets, "log": {}, "counts": {}}
        self.buckets = self.state["buckets"]

    def _bucket(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, kind: str, only: list[str] | None = None) -> DataFrame:
        """The current rows of all buckets or some of them."""
        versions = self.state[kind]
        paths = [f"{self.root}/{kind}/{v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
        schema = self.RECORD if kind == "log" else self.COUNT
        bare = schema.rsplit(",", 1)[0]
        rows = self.spark.read.schema(bare).option("recursiveFileLookup", True).parquet(*paths) if paths else self.spark.createDataFrame([], bare)
        return rows.withColumn("bucket", self._bucket("key" if kind == "log" else "term"))

    def _write(self, rows: DataFrame, kind: str, version: str) -> list[str]:
        """Write rows by bucket, one file for each, and say which buckets there are."""
        path = f"{self.root}/{kind}/{version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return [n.split("=", 1)[1] for n in self.files.names(path) if n.startswith("bucket=")]

    def _stage(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows of a batch, written aside, and their buckets."""
        staged = self.space.save(rows)
        return staged, [str(r[0]) for r in staged.select("bucket").distinct().collect()]

    def _written(self, kind: str, version: str) -> DataFrame:
        """Rows written a moment ago."""
        return self.spark.read.schema(self.RECORD if kind == "log" else self.COUNT).parquet(f"{self.root}/{kind}/{version}")

    def apply(self, batch: DataFrame) -> None:
        """batch: key, version, terms and, if wanted, deleted."""
        version = f"v{self.state['version'] + 1:08d}"
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        when = F.coalesce(F.col("version").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
        rows = batch.where(F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key"), when.alias("v"), F.array_compact("terms").cast("array<string>").alias("terms"), deleted.alias("deleted"))
        fresh = rows.groupBy("key").agg(F.max(F.struct("v", "terms", "deleted")).alias("new")).withColumn("bucket", self._bucket("key"))
        no_terms = F.lit(None).cast("array<string>")
        as_log = lambda x, before, changed: [F.col(f"{x}.v").alias("version"), F.col(f"{x}.terms").alias("terms"), F.col(f"{x}.deleted").alias("deleted"), before.alias("before"), changed.alias("changed"), "bucket"]
        first = fresh.select("key", *as_log("new", no_terms, F.lit(True)))
        if self.state["log"]:
            staged, touched = self._stage(first)
            new = staged.select("key", "bucket", F.struct(F.col("version").alias("v"), "terms", "deleted").alias("new"))
            old = self._read("log", touched).select("key", "bucket", F.struct(F.col("version").alias("v"), "terms", "deleted").alias("old"))
            both = old.join(new, ["bucket", "key"], "full_outer")
            newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") > F.col("old")))
            merged = both.select("key", "bucket", F.when(newer, F.col("new")).otherwise(F.col("old")).alias("x"), newer.alias("changed"), F.when(newer & ~F.col("old.deleted"), F.col("old.terms")).alias("before"))
            touched = self._write(merged.select("key", *as_log("x", F.col("before"), F.col("changed"))), "log", version)
            self.space.drop(staged)
        else:
            touched = self._write(first, "log", version)
        if not touched:
            return
        after = dict(self.state["log"]) | dict.fromkeys(touched, version)
        changed = self._written("log", version).where("changed")
        live = F.when(~F.col("deleted"), F.col("terms"))
        occurrences = changed.select(F.explode(_occurrences(live, 1)).alias("t")).unionByName(changed.select(F.explode(_occurrences(F.col("before"), -1)).alias("t")))
        deltas = occurrences.groupBy("t.term").agg(F.sum("t.o").cast("bigint").alias("n_occurrences"), F.sum("t.r").cast("bigint").alias("n_records"))
        deltas = deltas.where((F.col("n_occurrences") != 0) | (F.col("n_records") != 0)).select("*", self._bucket("term"))
        counts = dict(self.state["counts"])
        if counts:
            staged, moved = self._stage(deltas)
            every = self._read("counts", moved).unionByName(staged)
            merged = every.groupBy("bucket", "term").agg(F.sum("n_occurrences").cast("bigint").alias("n_occurrences"), F.sum("n_records").cast("bigint").alias("n_records"))
            kept = self._write(merged.where(F.col("n_records") > 0).select("term", "n_occurrences", "n_records", "bucket"), "counts", version)
            for b in moved:
                counts.pop(b, None)
            self.space.drop(staged)
        else:
            kept = self._write(deltas, "counts", version)
        self._commit(version, after, counts | dict.fromkeys(kept, version))

    def _commit(self, version: str, log: dict[str, str], counts: dict[str, str]) -> None:
        before = self.state
        self.state = {"version": before["version"] + 1, "buckets": self.buckets, "log": log, "counts": counts}
        self.files.write(f"{self.root}/manifest-{version}.json", json.dumps(self.state))
        for kind in ("log", "counts"):
            for b, v in before[kind].items():
                if self.state[kind].get(b) != v:
                    self.files.delete(f"{self.root}/{kind}/{v}/bucket={b}")
        if before["version"]:
            self.files.delete(f"{self.root}/manifest-v{before['version']:08d}.json")

    @property
    def counts(self) -> DataFrame:
        """term, n_occurrences, n_records, bucket; the null term counts everything."""
        return self._read("counts")

    def table(self, *, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
        """term, n_occurrences, n_records, is_rare, is_common. common_above is a share of all records."""
        counts = self.counts
        total = counts.where(F.col("term").isNull()).agg(F.coalesce(F.max("n_records"), F.lit(0)).alias("total"))
        terms = counts.where(F.col("term").isNotNull()).crossJoin(F.broadcast(total))  # one row
        return terms.select("term", "n_occurrences", "n_records", (F.col("n_records") < rare_below).alias("is_rare"), (F.col("n_records") > F.col("total") * common_above).alias("is_common"))


def _occurrences(terms: Column, sign: int) -> Column:
    """(term, o, r) of every occurrence, r only at a term's first one, and (null, all, 1) for the record itself; null without terms.

    Sorted terms are held against the same list moved by one, so the work is that of sorting.
    """
    line = F.array_sort(terms)
    moved = F.concat(F.array(F.lit(None).cast("string")), F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))))
    each = F.zip_with(line, F.when(F.size(line) > 0, moved).otherwise(line), lambda t, before: F.struct(t.alias("term"), F.lit(sign).cast("bigint").alias("o"), F.when(t.eqNullSafe(before), 0).otherwise(sign).cast("bigint").alias("r")))
    whole = F.struct(F.lit(None).cast("string").alias("term"), (F.size(terms) * sign).cast("bigint").alias("o"), F.lit(sign).cast("bigint").alias("r"))
    return F.when(terms.isNotNull(), F.concat(each, F.array(whole)))


def field_terms(*fields: str) -> Column:
    """The values of number fields as terms; null, NaN and infinite values are none, negative zero is 0, whole numbers have no point."""

    def value(f: str) -> Column:
        v = F.col(f).cast("double")
        whole = (v == F.floor(v)) & (F.abs(v) < 2.0**63)
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string")))

    return F.array_compact(F.array(*[value(f) for f in fields]))


def count_in_deliveries(rows: DataFrame, *, key: str, version: str, fields: list[str], shares: tuple[float, ...] = (0.5, 0.75, 0.9), folder: str | None = None) -> TermCounts:
    """Count rows as they would have come in: a first load up to the share shares[0] of the version column, then a batch for each further share."""
    counts = TermCounts(rows.sparkSession, folder)
    typed = rows.select(F.col(key).alias("key"), F.col(version).alias("version"), field_terms(*fields).alias("terms"))
    cuts = [c for c in rows.select(F.percentile_approx(F.col(version), list(shares), 1000)).first()[0] or [] if c is not None]
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = typed
        if high is not None:
            part = part.where(F.col("version").isNull() | (F.col("version") <= F.lit(high)) if low is None else F.col("version") <= F.lit(high))
        if low is not None:
            part = part.where(F.col("version") > F.lit(low))
        counts.apply(part)
    return counts
