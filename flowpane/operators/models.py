"""Supervised window and flow classifiers on MLlib, with balanced classes, and forest importances.

These fill the roles of the classifiers they stand for. MLlib's trees, margins and networks are not the same models,
so their numbers differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.operators.sampling import stratified_sample


def vectors(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """Adds ``features`` from columns, or from one array column."""
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(features))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (2 * rows of the class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    w = F.lit(1.0)
    for c, k in counts.items():
        w = F.when(F.col(label) == c, n / (len(counts) * k)).otherwise(w)
    return df.withColumn("weight", w)


def _scored(model, test: DataFrame, features, column: str) -> DataFrame:
    out = model.transform(vectors(test, features))
    return (out.withColumn("prob", vector_to_array(column)[1]).withColumn("pred", F.col("prediction").cast("int"))
            .select(*test.columns, "prob", "pred"))


def rf_classify(train: DataFrame, test: DataFrame, features: Sequence[str] | str, label: str = "label", trees: int = 100,
                depth: int = 10, seed: int = 42) -> DataFrame:
    """``test`` with ``prob`` and ``pred`` from a random forest (depth at most 30)."""
    rf = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return _scored(rf.fit(vectors(balanced_weight(train, label), features)), test, features, "probability")


def svm_classify(train: DataFrame, test: DataFrame, features: Sequence[str] | str, label: str = "label",
                 iterations: int = 50) -> DataFrame:
    """``test`` with the raw margin as ``prob`` and ``pred`` from a linear support vector machine."""
    svm = LinearSVC(labelCol=label, weightCol="weight", maxIter=iterations)
    return _scored(svm.fit(vectors(balanced_weight(train, label), features)), test, features, "rawPrediction")


def mlp_classify(train: DataFrame, test: DataFrame, features: Sequence[str] | str, width: int, label: str = "label",
                 hidden: Sequence[int] = (512, 256), iterations: int = 50, seed: int = 42) -> DataFrame:
    """``test`` with ``prob`` and ``pred`` from a perceptron on ``width`` inputs."""
    net = MultilayerPerceptronClassifier(labelCol=label, layers=[width, *hidden, 2], maxIter=iterations, seed=seed, blockSize=64)
    return _scored(net.fit(vectors(train, features)), test, features, "probability")


def rf_importance(df: DataFrame, features: Sequence[str], label: str = "label", key: str | None = None,
                  sample: int | None = None, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """(feature, ordinal, importance) of a forest on flow rows or window statistics; with ``sample`` and ``key``, on a
    stratified sample of that many rows."""
    rows = stratified_sample(df, label, key, sample, seed) if sample and key else df
    rf = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    model = rf.fit(vectors(balanced_weight(rows.select(label, *features), label), features))
    values = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(f, i, float(v)) for i, (f, v) in enumerate(zip(features, values))], "feature string, ordinal int, importance double")
