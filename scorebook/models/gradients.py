"""Spark ML's factorisation machine fitted by the same steps, with the gradients of whole blocks of samples.

Start, loss, gradient, AdamW step and the test of convergence are those of
`FMRegressor`; sums are added in another order, so coefficients agree up to
rounding. Samples are packed once into blocks by task. A pass sends the
coefficients out and brings back one gradient per task: a block's samples meet
the vectors of their features in matrix products, where Spark makes a gradient
of full length for each sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.regression import FMRegressionModel, FMRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.session import discard, materialized, ship

_KINDS = {"y": "<f8", "counts": "<i4", "columns": "<i4", "place": "<i4", "value": "<f8"}
_DENSE = 256  # different features of a block up to which its samples become a matrix


def _packed(train: DataFrame, features: str, label: str) -> DataFrame:
    """Blocks of samples as bytes: labels, values per sample, the features that occur, and each value with its feature's place there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, vector = batch.column(0), batch.column(1)
            if y.null_count or vector.null_count or np.isnan(y.to_numpy()).any():
                raise ValueError("a label is null or NaN, or a vector is null")
            indices, values = vector.field("indices"), vector.field("values")
            counts = np.diff(values.offsets.to_numpy())
            whole = np.repeat(indices.is_null().to_numpy(zero_copy_only=False), counts)  # dense vectors name no indices
            flat = np.arange(len(whole)) - np.repeat(np.cumsum(counts) - counts, counts)
            flat[~whole] = indices.flatten().to_numpy()
            columns, place = np.unique(flat, return_inverse=True)
            value = values.flatten().to_numpy()
            parts = dict(zip(_KINDS, (y.to_numpy(), counts, columns, place, value)))
            arrays = [pa.array([x.astype(_KINDS[c]).tobytes()], pa.binary()) for c, x in parts.items()]
            yield pa.RecordBatch.from_arrays(arrays, list(_KINDS))

    rows = train.select(F.col(label).cast("double").alias("y"), F.unwrap_udt(F.col(features)).alias("x"))
    blocks = rows.mapInArrow(run, ", ".join(f"{c} binary" for c in _KINDS))
    return materialized(blocks.repartition(train.sparkSession.sparkContext.defaultParallelism), "fm-blocks")


def block_gradient(
    y: np.ndarray, counts: np.ndarray, place: np.ndarray, value: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray,
    dense: int = _DENSE,
) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums over a block of the squared errors and of their slopes along the bias, the weights and the vectors of its features."""
    row, width = np.repeat(np.arange(len(y)), counts), len(linear)
    if width <= dense:
        x = np.bincount(row * width + place, value, len(y) * width).reshape(len(y), width)
        sums, squared = x @ factors, x * x
        raw = bias + x @ linear + (sums * sums).sum(axis=1) / 2 - squared @ (factors * factors).sum(axis=1) / 2
        slope = 2 * (raw - y)
        return ((raw - y) ** 2).sum(), slope.sum(), x.T @ slope, x.T @ (sums * slope[:, None]) - factors * (slope @ squared)[:, None]
    products = factors[place] * value[:, None]
    some, sums = np.flatnonzero(counts), np.zeros((len(y), factors.shape[1]))
    sums[some] = np.add.reduceat(products, (np.cumsum(counts) - counts)[some]) if len(some) else 0.0
    raw = bias + np.bincount(row, linear[place] * value - (products * products).sum(axis=1) / 2, len(y)) + (sums * sums).sum(axis=1) / 2
    slope = 2 * (raw - y)
    order = np.argsort(place, kind="stable")  # every feature of the block stands in it
    pulls = (sums * slope[:, None])[row[order]] * value[order, None]
    first = np.searchsorted(place[order], np.arange(width))
    of_vectors = np.add.reduceat(pulls, first) - factors * np.bincount(place, slope[row] * value * value, width)[:, None]
    return ((raw - y) ** 2).sum(), slope.sum(), np.bincount(place, slope[row] * value, width), of_vectors


def _gradient(blocks: DataFrame, weights: np.ndarray, features: int, size: int) -> np.ndarray:
    """Sum of the samples' gradients, in the order of Spark's coefficients: vectors, weights, bias."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(weights))
        factors, linear, bias = weights[: features * size].reshape(features, size), weights[features * size : -1], weights[-1]
        to_factors, to_linear = out[: features * size].reshape(features, size), out[features * size : -1]
        for batch in batches:
            for block in zip(*batch.columns):
                y, counts, columns, place, value = [np.frombuffer(b.as_buffer(), k) for b, k in zip(block, _KINDS.values())]
                _, b, l, v = block_gradient(y, counts, place, value, bias, linear[columns], factors[columns])
                out[-1] += b
                to_linear[columns] += l
                to_factors[columns] += v
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return sum(np.frombuffer(bytes(row.sums), np.float64) for row in blocks.mapInArrow(run, "sums binary").collect())


def fit(estimator: FMRegressor, train: DataFrame) -> FMRegressionModel:
    """What `estimator.fit(train)` gives, for its solver adamW over all samples with weights and bias."""
    known = (estimator.getSolver(), estimator.getMiniBatchFraction(), estimator.getFitLinear(), estimator.getFitIntercept())
    if known != ("adamW", 1.0, True, True):
        raise ValueError(f"only adamW over all samples with weights and bias is built, not {known}")
    spark = train.sparkSession
    ship(spark)
    first = train.select(estimator.getFeaturesCol()).first()
    if first is None:
        raise ValueError("no samples to fit")
    features, size = first[0].size, estimator.getFactorSize()
    blocks = _packed(train, estimator.getFeaturesCol(), estimator.getLabelCol())
    n = train.count()
    draw = spark.sparkContext._jvm.java.util.Random(estimator.getSeed())
    start = [draw.nextGaussian() * estimator.getInitStd() for _ in range(features * size)]
    w = np.concatenate([start, np.zeros(features + 1)])
    mean, spread = np.zeros(len(w)), np.zeros(len(w))
    step, decay = estimator.getStepSize(), estimator.getRegParam()
    for i in range(1, estimator.getMaxIter() + 1):
        g = _gradient(blocks, w, features, size) / n
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        moved = w - step * (mean / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.999**i)) + 1e-8) - decay * w  # the step does not scale the decay
        before, w = w, moved
        if np.linalg.norm(before - w) < estimator.getTol() * max(np.linalg.norm(w), 1.0):
            break
    discard(blocks)
    context = spark.sparkContext
    parts = Vectors.dense(w[features * size : -1]), DenseMatrix(features, size, w[: features * size].tolist(), True)
    made = context._jvm.org.apache.spark.ml.regression.FMRegressionModel(estimator.uid, float(w[-1]), *[_py2java(context, p) for p in parts])
    return FMRegressionModel(made)
