"""Classification: linear support vector machines, one against the rest, with balanced class weights, trained by Spark ML.

A fitted model is kept as plain coefficients and applied as a column expression. So prediction stays inside code generation, runs over
any number of rows without a shuffle, and carries no reference to the session a model was trained in.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20261010
#: A classifier is fitted on at most so many labelled rows, the first by hash of their id; everything else covers all rows.
MOST_TRAINING_ROWS = 200_000


class LinearModel(NamedTuple):
    """One hyperplane a class; the class of a vector is the one with the largest margin, the first of equal ones."""

    coefficients: list[list[float]]
    intercepts: list[float]


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with a weight: all / (classes * rows of the class). Class counts are one small table."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n_all"), F.count(F.lit(1)).alias("k"))
    return rows.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("n_all") / (F.col("k") * F.col("n_class"))).drop("n_class", "n_all", "k")


def fit_linear(rows: DataFrame, vector: str, label: str, id_col: str) -> LinearModel:
    bounded = rows.orderBy(F.xxhash64(id_col), id_col).limit(MOST_TRAINING_ROWS)
    training = balanced_weights(bounded, label).select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), "weight")
    fitted = OneVsRest(classifier=LinearSVC(regParam=1e-4, maxIter=30), weightCol="weight", parallelism=2).fit(training)
    return LinearModel([m.coefficients.toArray().tolist() for m in fitted.models], [float(m.intercept) for m in fitted.models])


def predicted(model: LinearModel, rows: DataFrame, vector: str) -> DataFrame:
    """rows with a prediction; a null vector or one of another dimension has none."""
    v = F.col(vector)
    margins = []
    for weights, intercept in zip(*model):
        products = F.zip_with(v, F.lit(weights), lambda x, w: x.cast("double") * w)
        margins.append(F.aggregate(products, F.lit(intercept), lambda s, x: s + x))
    every = F.array(*margins)
    best = (F.array_position(every, F.array_max(every)) - 1).cast("double")
    return rows.withColumn("prediction", F.when(F.size(v) == len(model.coefficients[0]), best))
