"""Six small networks that vote: multilayer perceptrons of Spark's own library on one-hot residues, seen at several widths."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import RESIDUES
from strandmill.operators.metrics import majority
from strandmill.plans.storage import Workspace

WIDTH = 40
#: Training reads a bounded sample of the labelled rows: a parameter, not a limit of inference.
SAMPLE_ROWS = 20_000
STEPS = 40

#: (places that are seen together, hidden layers) of each network: seen[w] sums each residue over w neighbouring places, as a pooled window does.
MODELS: dict[str, tuple[int, list[int]]] = {
    "places_32_32": (1, [32, 32]),
    "places_16": (1, [16]),
    "pairs_16": (2, [16]),
    "fours_16": (4, [16]),
    "fives_16": (5, [16]),
    "tens_16": (10, [16]),
}


def seen(seq: Column, together: int, width: int = WIDTH) -> Column:
    """Vector of len(RESIDUES) * width / together numbers: how often each residue stands in each stretch of the centred sequence.

    Letters outside the alphabet count nowhere; of longer sequences both ends are cut evenly, as the networks have a fixed width; null counts as empty.
    """
    text = F.coalesce(seq, F.lit(""))
    cut = F.greatest(F.length(text) - width, F.lit(0))
    kept = F.substring(text, F.floor(cut / 2).cast("int") + 1, F.lit(width))
    left = F.floor((width - F.length(kept)) / 2).cast("int")
    padded = F.rpad(F.concat(F.repeat(F.lit("-"), left), kept), width, "-")
    stretches = F.transform(F.sequence(F.lit(0), F.lit(width // together - 1)), lambda i: F.substring(padded, i * together + 1, F.lit(together)))
    counts = F.flatten(F.transform(stretches, lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(r), F.lit("")))).cast("double") for r in RESIDUES])))
    return array_to_vector(counts)


def train_ensemble(rows: DataFrame, *, steps: int = STEPS, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> dict[str, MultilayerPerceptronClassificationModel]:
    """The six networks, each fitted on the same bounded sample of rows (seq, label); three at a time share the cluster."""
    labelled = rows.where(F.col("seq").isNotNull() & F.col("label").isNotNull()).select("seq", F.col("label").cast("double").alias("label"))
    space = Workspace(rows.sparkSession, "ensemble")
    sample = space.save(labelled.orderBy(F.xxhash64("seq", F.lit(seed)), "seq").limit(sample_rows))

    def fit(name: str) -> MultilayerPerceptronClassificationModel:
        together, hidden = MODELS[name]
        inputs = len(RESIDUES) * (WIDTH // together)
        network = MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=steps, seed=seed, featuresCol="features", labelCol="label")
        return network.fit(sample.select(seen(F.col("seq"), together).alias("features"), "label").repartition(sample.sparkSession.sparkContext.defaultParallelism))

    with ThreadPool(3) as pool:
        return dict(zip(MODELS, pool.map(fit, MODELS)))


def predict(rows: DataFrame, models: dict[str, MultilayerPerceptronClassificationModel], *, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep..., p_<model> (of class 1), mean_p and vote of all rows; null sequences count as empty."""
    out, done = rows.select(*keep, "seq"), []
    for name, model in models.items():
        model = model.copy().setFeaturesCol(f"x_{name}").setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"y_{name}")
        out = model.transform(out.withColumn(f"x_{name}", seen(F.col("seq"), MODELS[name][0])))
        done.append(vector_to_array(F.col(f"y_{name}"))[1].alias(f"p_{name}"))
    scored = out.select(*keep, *done)
    p = [F.col(f"p_{m}") for m in models]
    mean = sum(p[1:], p[0]) / len(p)
    return scored.withColumn("mean_p", mean).withColumn("vote", majority([(x > 0.5).cast("int") for x in p]))
