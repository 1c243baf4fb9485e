"""K-mer counts and models on them."""

from __future__ import annotations

import string
from itertools import product

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import kmers

#: Fixed value: the letters of a k-mer are all but these; the pad letter J is one of them.
LETTERS = "".join(c for c in string.ascii_uppercase if c not in "BOUZX")
K = 3


def kmer_counts(rows: DataFrame, k: int = K, *, ident: str = "id") -> DataFrame:
    """id, kmer, n: non-overlapping occurrences from the left, for k-mers over the alphabet. Narrow: no shuffle."""
    windows = rows.where(F.col("seq").isNotNull()).select(ident, "seq", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    return windows.where(F.col("kmer").rlike(f"^[{LETTERS}]+$")).select(ident, "kmer", F.regexp_count("seq", F.col("kmer")).alias("n"))


def vocabulary(k: int = K) -> list[str]:
    """All k-mers over the alphabet, each a column of its own: 9,261 for k = 3."""
    return ["".join(x) for x in product(LETTERS, repeat=k)]


def kmer_vectors(rows: DataFrame, k: int = K, *, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """id, keep..., features: sparse counts of the k-mers of each row, non-overlapping from the left, one column for each k-mer of the vocabulary."""
    times = lambda x: ((F.length("seq") - F.length(F.replace("seq", x, F.lit("")))) / k).cast("int")
    terms = F.flatten(F.transform(kmers(F.col("seq"), k), lambda x: F.array_repeat(x, times(x))))
    model = CountVectorizerModel.from_vocabulary(vocabulary(k), inputCol="terms", outputCol="features")
    return model.transform(rows.where(F.col("seq").isNotNull()).withColumn("terms", terms)).select("id", *keep, "features")


def kmer_totals(vectors: DataFrame, k: int = K) -> DataFrame:
    """kmer, n: sums of the columns of all vectors, for k-mers that occur; a row of fixed width is summed on the way."""
    sums = vectors.select(vector_to_array(Summarizer.sum(F.col("features"))).alias("sums"))
    every = sums.select(F.posexplode("sums").alias("at", "n")).where("n > 0")
    return every.select(F.get(F.array(*[F.lit(x) for x in vocabulary(k)]), F.col("at")).alias("kmer"), F.col("n").cast("bigint").alias("n"))


def logistic_cv(train: DataFrame, *, folds: int = 3, seed: int = 1):
    """Logistic regression, its penalty chosen by cross-validation."""
    lr = LogisticRegression(maxIter=30)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    kept = train.persist()
    try:
        return CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed, parallelism=3).fit(kept).bestModel
    finally:
        kept.unpersist()


def forest(train: DataFrame, *, trees: int = 20, regression: bool = False, seed: int = 1):
    """A third of the columns is tried at each split: most k-mers don't occur, so a root of them would often hold none that tells rows apart."""
    model = (RandomForestRegressor if regression else RandomForestClassifier)(numTrees=trees, seed=seed, maxDepth=8, featureSubsetStrategy="onethird")
    return model.fit(train)


def linear_svm(train: DataFrame):
    """A linear machine; an RBF kernel needs all pairs of rows and isn't offered."""
    return LinearSVC(maxIter=30).fit(train)
