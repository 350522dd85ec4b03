"""Regressors of runs scored through Spark ML, and tables that compare them.

Samples carry an array column `vec` and a label column. Every fit is a Spark
job over the samples; only coefficients and metric rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import FMRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.models import forests, gradients
from scorebook.operators.scaling import mean_baseline, standardized_vector
from scorebook.operators.summary import mse

# Labels of the ranking report.
IMPACT = {True: "プラス貢献", False: "マイナス影響"}


@contextmanager
def kept(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Frames stored for repeated passes, released at the end."""
    stored = tuple(f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames)
    try:
        yield stored
    finally:
        for f in stored:
            f.unpersist()


def with_vector(df: DataFrame, vec: str = "vec", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))


def linear(label: str = "runs") -> LinearRegression:
    """Least squares from the normal equations: one pass over the data."""
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0)


def lasso(alpha: float, label: str = "runs") -> LinearRegression:
    """L1 regression on features that are standardised already.

    The normal-equation solver also needs one pass; the iterations run on the
    small moment matrix.
    """
    return LinearRegression(
        featuresCol="features", labelCol=label, solver="normal", regParam=alpha,
        elasticNetParam=1.0, standardization=False, tol=1e-9, maxIter=1000,
    )


def forest(label: str = "runs", trees: int = 100, depth: int = 30, seed: int = 42) -> forests.Forest:
    """Trees over all features, grown by tasks that finish whole subtrees; reads the array column `vec`."""
    return forests.Forest(label, trees, depth, seed)


def factorization(
    label: str = "runs", factors: int = 16, epochs: int = 100, step: float = 0.0001, decay: float = 0.1, seed: int = 42
) -> FMRegressor:
    """Factorisation machine over one-hot players and numeric features."""
    return FMRegressor(
        featuresCol="features", labelCol=label, factorSize=factors, maxIter=epochs,
        stepSize=step, regParam=decay, initStd=0.01, solver="adamW", seed=seed,
    )


def scaled_pair(train: DataFrame, valid: DataFrame, width: int, fit_on: str = "train") -> tuple[DataFrame, DataFrame]:
    """Both sides standardised with the statistics of the training side, or of all rows."""
    if fit_on == "train":
        fit = train
    elif fit_on == "all":
        fit = train.unionByName(valid)
    else:
        raise ValueError(f"unknown fit_on {fit_on!r}")
    return standardized_vector(train, "vec", width, fit), standardized_vector(valid, "vec", width, fit)


def prediction_mse(model: Model, valid: DataFrame, label: str = "runs") -> DataFrame:
    return mse(model.transform(valid), label, "prediction")


class Entry(NamedTuple):
    """One model of a comparison; a scaled one gets standardised features, the others raw ones."""

    name: str
    estimator: object | None = None
    scaled: bool = False


def compare(
    train: DataFrame, valid: DataFrame, width: int, models: Sequence[Entry],
    label: str = "runs", truncate: bool = True,
) -> DataFrame:
    """(model, mse) rows of the entries; one without an estimator is the mean baseline."""

    def error(entry: Entry) -> DataFrame:
        if entry.estimator is None:
            return mse(mean_baseline(train, valid, label, truncate), label, "prediction")
        fit_on, check_on = scaled if entry.scaled else (train, valid)
        return prediction_mse(entry.estimator.fit(with_vector(fit_on)), with_vector(check_on), label)

    with kept(train, valid) as (train, valid):
        scaled = scaled_pair(train, valid, width)
        rows = [(entry.name, error(entry).first()["mse"]) for entry in models]
        return train.sparkSession.createDataFrame(rows, "model string, mse double")


def default_models(label: str = "runs", alpha: float = 0.1, trees: int = 100, depth: int = 30) -> list[Entry]:
    return [
        Entry("Baseline (Mean)"),
        Entry("Linear Regression", linear(label), scaled=True),
        Entry("Lasso Regression", lasso(alpha, label), scaled=True),
        Entry("Random Forest", forest(label, trees, depth)),
    ]


def compare_patterns(
    patterns: Mapping[str, tuple[DataFrame, DataFrame, int]], alpha: float = 0.05, label: str = "runs"
) -> DataFrame:
    """(pattern, dims, active, mse) of one lasso per pattern of (train, valid, width)."""
    rows, spark = [], None
    for name, (train, valid, width) in patterns.items():
        with kept(train, valid) as (train, valid):
            spark = train.sparkSession
            fit_on, check_on = scaled_pair(train, valid, width)
            model = lasso(alpha, label).fit(with_vector(fit_on))
            active = int((model.coefficients.toArray() != 0).sum())
            rows.append((name, width, active, prediction_mse(model, with_vector(check_on), label).first()["mse"]))
    return spark.createDataFrame(rows, "pattern string, dims int, active int, mse double")


def weights(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """(pos, feature, weight) rows of a linear model, one per feature."""
    rows = [(i, n, float(w)) for i, (n, w) in enumerate(zip(names, model.coefficients.toArray(), strict=True))]
    return spark.createDataFrame(rows, "pos int, feature string, weight double")


def weight_ranking(weight_rows: DataFrame, top: int | None = None) -> DataFrame:
    """Non-zero weights by size, with their direction."""
    ranked = (
        weight_rows.filter("weight <> 0")
        .withColumns(
            {
                "abs_weight": F.abs("weight"),
                "impact": F.when(F.col("weight") > 0, F.lit(IMPACT[True])).otherwise(F.lit(IMPACT[False])),
            }
        )
        .orderBy(F.desc("abs_weight"), "pos")
    )
    return ranked if top is None else ranked.limit(top)


def ranking_lines(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn(
        "line", F.format_string("%-20s | 係数: %7.4f | %s", "feature", "weight", "impact")
    )


def objective_rows(spark: SparkSession, model: Model, every: int = 1) -> DataFrame:
    """(iteration, objective) of a fit, each `every` iterations."""
    history = model.summary.objectiveHistory
    rows = [(i, float(v)) for i, v in enumerate(history)]
    return spark.createDataFrame(rows, "iteration int, objective double").filter(
        F.pmod(F.col("iteration"), F.lit(every)) == 0
    )


def one_hot(df: DataFrame, ids: str, size: int, numeric: str | None = None, out: str = "features") -> DataFrame:
    """Sparse indicator vector of the ids 0 … size-1 in an array column, then an array of numbers."""
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], ids, "_ids")
    df = counter.transform(df.withColumn(ids, F.transform(ids, lambda i: i.cast("string"))))
    if numeric is None:
        return df.withColumnRenamed("_ids", out)
    df = df.withColumn("_numbers", array_to_vector(F.col(numeric).cast("array<double>")))
    return VectorAssembler(inputCols=["_ids", "_numbers"], outputCol=out).transform(df).drop("_ids", "_numbers")


def factor_rows(spark: SparkSession, model: Model, size: int) -> DataFrame:
    """(id, v) rows: the factor vectors of the first `size` features, for the affinity report."""
    matrix = model.factors.toArray()
    return spark.createDataFrame(
        [(i, [float(x) for x in matrix[i]]) for i in range(size)], "id int, v array<double>"
    )


def fit_fm(
    train: DataFrame, valid: DataFrame, label: str = "runs", **settings
) -> tuple[Model, DataFrame]:
    """Fitted factorisation machine and its (side, mse) rows."""
    with kept(train, valid) as (train, valid):
        model = gradients.fit(factorization(label, **settings), train)
        rows = [
            (side, mse(model.transform(df), label, "prediction").first()["mse"])
            for side, df in (("train", train), ("valid", valid))
        ]
        return model, train.sparkSession.createDataFrame(rows, "side string, mse double")
