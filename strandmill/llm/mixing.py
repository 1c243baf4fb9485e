"""Problem 8: mixing sources to target shares of tokens, with a cap on repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.tokens import VOCABULARY, _encoder
from strandmill.plans.storage import Workspace

#: Parts of the key's range by which running sums are formed without sorting a whole source in one task.
SLICES = 512
MAX_SOURCES = 10_000


def source_key(source: Column) -> Column:
    return F.replace(F.lower(F.trim(source)), F.lit("_"), F.lit("-"))


def text_sizes(documents: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, text_id, n_tokens, quality of every document with a text. quality: characters in a token, low for what no language is.

    text_id is a digest of the text and its length, equal for equal texts.
    """
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            counts = [encoder.count(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), batch.column(4)], ["doc_id", "source", "text_id", "n_tokens", "n_chars"])

    rows = documents.where(F.length("text") > 0).select("doc_id", source_key(F.col("source")).alias("source"), F.unhex(F.md5("text")).alias("text_id"), "text", F.length("text").cast("bigint").alias("n_chars"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    sized = rows.mapInArrow(run, f"doc_id {kind}, source string, text_id binary, n_tokens bigint, n_chars bigint")
    return sized.select("doc_id", "source", "text_id", "n_tokens", (F.col("n_chars") / F.col("n_tokens")).alias("quality"))


def budgets(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source is to give: its share of the total, at most caps times its size.

    What a source can't give goes to the others in proportion to their shares, as far as they can. The total is that of
    all sources' texts, if none is given.
    """
    total = float(sum(sizes.values())) if total is None else total
    most = {s: float(sizes.get(s, 0) * max(caps[s], 0)) for s in shares}
    fixed: dict[str, float] = {}
    while True:
        free = {s: shares[s] for s in shares if s not in fixed and shares[s] > 0}
        left, whole = max(0.0, total - sum(fixed.values())), sum(free.values())
        wanted = {s: left * share / whole for s, share in free.items()}
        over = [s for s in free if wanted[s] >= most[s]]
        if not over:
            return {s: fixed.get(s, wanted.get(s, 0.0)) for s in shares}
        fixed |= {s: most[s] for s in over}


class Mixture:
    """Uses of each text so that sources get their target shares of all tokens.

    Equal texts are one text: it belongs to the source of its smallest doc_id, which stands for its copies, and the cap
    holds for all of them together. Each source is first used in whole epochs; the rest of its budget is a sample without
    replacement by the method of Efraimidis and Spirakis: keys -ln(u) / quality, u from a hash of text and seed, in rising
    order as long as their running sum of tokens fits. Running sums come from the sums of slices of the key's range; only
    the slice in which the budget ends is sorted.

    Defined results: shares are scaled to 1; of several targets for one source the first by share and cap counts; null or
    negative shares are 0, null caps 1; sources that are null or not among the targets, and null or empty texts, are not
    used; targets without texts give nothing and appear in the shares with 0.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> None:
        spark = documents.sparkSession
        wanted = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
        rows = wanted.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("share", "cap")).alias("x")).select("source", "x.*").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        whole = sum(r["share"] for r in rows) or 1.0
        self.shares, self.caps = {r["source"]: r["share"] / whole for r in rows}, {r["source"]: r["cap"] for r in rows}
        space = Workspace(spark, "mixture")
        kept = documents.where(source_key(F.col("source")).isin(list(self.shares)))
        first = text_sizes(kept, vocabulary=vocabulary).groupBy("text_id", "n_tokens").agg(F.min(F.struct("doc_id", "source", "quality")).alias("x"))
        u = (F.pmod(F.xxhash64("text_id", F.lit(seed)), F.lit(2**52)) + 0.5) / F.lit(2.0**52)
        keyed = first.select("x.doc_id", "x.source", "n_tokens", (-F.log(u) / F.col("x.quality")).alias("key"))
        self.texts = space.save(keyed.withColumn("slice", F.floor(F.lit(SLICES) * (1 - F.exp(-4 * F.col("key")))).cast("int")))

        slices = space.save(self.texts.groupBy("source", "slice").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
        self.sizes = {r["source"]: (r["tokens"], r["n"]) for r in slices.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()}
        self.budgets = budgets({s: t for s, (t, _) in self.sizes.items()}, self.shares, self.caps, total)
        plan = []
        for s, (size, _) in self.sizes.items():
            epochs = min(int(self.budgets[s] // size), self.caps[s])
            plan.append((s, epochs, float(self.budgets[s] - epochs * size) if epochs < self.caps[s] else 0.0))
        plans = spark.createDataFrame(plan, "source string, epochs int, rest double")
        before = F.sum("tokens").over(W.partitionBy("source").orderBy("slice")) - F.col("tokens")
        self.slices = slices.withColumn("before", before).join(plans, "source").select("source", "slice", "before", "tokens", "epochs", "rest")

    def uses(self) -> DataFrame:
        """doc_id, source, n_tokens, uses of every text that is used at all."""
        placed = self.texts.join(self.slices, ["source", "slice"])
        whole = placed.where(F.col("before") + F.col("tokens") <= F.col("rest")).withColumn("extra", F.lit(1))
        none = placed.where(F.col("before") >= F.col("rest")).withColumn("extra", F.lit(0))
        split = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))
        running = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
        cut = split.withColumn("extra", (running <= F.col("rest")).cast("int"))
        every = whole.unionByName(none).unionByName(cut)
        return every.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("uses")).where(F.col("uses") > 0)

    def report(self) -> DataFrame:
        """source, target_share, actual_share, budget, available_tokens, used_tokens, n_texts, n_used, n_uses, most_uses of every target."""
        rows = [(s, self.shares[s], self.budgets[s], *self.sizes.get(s, (0, 0))) for s in self.shares]
        targets = self.texts.sparkSession.createDataFrame(rows, "source string, target_share double, budget double, available_tokens bigint, n_texts bigint")
        used = self.uses().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("n_used"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses")
        )
        both = targets.join(used, "source", "left").fillna(0, ["used_tokens", "n_used", "n_uses", "most_uses"])
        return both.withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(W.partitionBy())), F.lit(0.0)))

    def check(self) -> DataFrame:
        """source, capped, within: whether no text of a target's source is used too often, and no more tokens are used than its budget."""
        caps = self.texts.sparkSession.createDataFrame(list(self.caps.items()), "source string, cap int")
        return self.report().join(caps, "source").select("source", (F.col("most_uses") <= F.col("cap")).alias("capped"), (F.col("used_tokens") <= F.col("budget") + 1e-6).alias("within"))
