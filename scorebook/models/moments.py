"""Linear models from one moment matrix.

Counts, means and co-moments of all features and the label are one distributed
aggregate per side of a split. Least squares, every lasso and every error of
theirs follow from that matrix, so the samples are read once however many models
are fitted. Its size is the square of the number of features, whatever the
number of samples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Share of the largest eigenvalue below which a direction counts as without variance.
FLAT = 1e-10
# Share of a mean below which a deviation is rounding.
ROUNDING = 1e-12


class Moments(NamedTuple):
    """Rows, means and co-moments (sums of products of deviations); the label comes last."""

    n: int
    mean: np.ndarray
    co: np.ndarray


class Fit(NamedTuple):
    """A linear model on standardised features, with the gradient of its squared error and its objective per sweep."""

    weights: np.ndarray
    intercept: float
    mean: np.ndarray
    std: np.ndarray
    gradient: np.ndarray
    objective: tuple[float, ...]


def _merged(a: Moments | None, b: Moments) -> Moments:
    """Moments of two sets of rows together; deviations are taken from the common mean, so nothing large cancels."""
    if a is None:
        return b
    n, apart = a.n + b.n, b.mean - a.mean
    return Moments(n, a.mean + apart * (b.n / n), a.co + b.co + np.outer(apart, apart) * (a.n * b.n / n))


def _of_rows(rows: np.ndarray) -> Moments:
    mean = rows.mean(0)
    apart = rows - mean
    return Moments(len(rows), mean, apart.T @ apart)


def partial_moments(df: DataFrame, width: int, vec: str = "vec", label: str = "runs", by: str = "is_valid") -> DataFrame:
    """(by, n, i, j, si, sj, c): per task and side, sums and co-moments of every pair of places, the label at place `width`."""
    first, second = np.triu_indices(width + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Moments] = {}
        for batch in batches:
            side, vectors, labels = batch.columns
            if not len(side):
                continue
            if set(vectors.value_lengths().to_pylist()) != {width}:
                raise ValueError(f"a vector has not the length {width}")
            places = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            rows = np.column_stack([places, labels.to_numpy(zero_copy_only=False)])
            sides = side.to_numpy(zero_copy_only=False)
            for s in np.unique(sides):
                found[bool(s)] = _merged(found.get(bool(s)), _of_rows(rows[sides == s]))
        for s, m in found.items():
            k = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * k), pa.array([m.n] * k), pa.array(first, pa.int32()), pa.array(second, pa.int32()),
                 pa.array(m.mean[first] * m.n), pa.array(m.mean[second] * m.n), pa.array(m.co[first, second])],
                ["side", "n", "i", "j", "si", "sj", "c"],
            )

    ready = df.select(F.col(by).cast("boolean"), F.col(vec).cast("array<double>"), F.col(label).cast("double"))
    whole = ready.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ready.columns))
    return whole.mapInArrow(run, "side boolean, n long, i int, j int, si double, sj double, c double")


def moment_rows(df: DataFrame, width: int, vec: str = "vec", label: str = "runs", by: str = "is_valid") -> DataFrame:
    """(side, i, j, n, mean_i, mean_j, co) of every pair of places, per side of a split.

    Rows without a side, a vector or a label are left out; a vector of another
    length is an error.
    """
    parts = partial_moments(df, width, vec, label, by)
    # Tasks' means are held against the mean of all; the window and the sums share one shuffle of a few rows per task.
    all_parts = Window.partitionBy("side", "i", "j")
    apart = parts.withColumns({f"m{k}": F.sum(f"s{k}").over(all_parts) / F.sum("n").over(all_parts) for k in "ij"})
    between = F.col("n") * (F.col("si") / F.col("n") - F.col("mi")) * (F.col("sj") / F.col("n") - F.col("mj"))
    return apart.groupBy("side", "i", "j").agg(
        F.sum("n").alias("n"), F.any_value("mi").alias("mean_i"), F.any_value("mj").alias("mean_j"), F.sum(F.col("c") + between).alias("co")
    )


def collected(rows: DataFrame, width: int) -> dict[bool, Moments]:
    """The moments of each side; as many numbers as pairs of places."""
    found: dict[bool, Moments] = {}
    for r in rows.collect():
        if r.side not in found:
            found[r.side] = Moments(r.n, np.zeros(width + 1), np.zeros((width + 1, width + 1)))
        m = found[r.side]
        m.mean[r.i], m.mean[r.j] = r.mean_i, r.mean_j
        m.co[r.i, r.j] = m.co[r.j, r.i] = r.co
    return found


def split_moments(df: DataFrame, width: int, **columns) -> tuple[Moments, Moments]:
    """Moments of the training and the validation side, from one pass."""
    found = collected(moment_rows(df, width, **columns), width)
    if set(found) != {False, True}:
        raise ValueError("both sides of the split need rows")
    return found[False], found[True]


def _standard(train: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations of the features (1 for a constant one), their correlation matrix, and their covariances with the label."""
    cov = train.co / train.n
    spread = np.maximum(np.diag(cov)[:-1], 0)
    std = np.sqrt(np.where(spread > (ROUNDING * train.mean[:-1]) ** 2, spread, 0))
    live = std > 0
    std = np.where(live, std, 1)
    gram = np.where(np.outer(live, live), cov[:-1, :-1] / np.outer(std, std), 0)
    return std, gram, np.where(live, cov[:-1, -1] / std, 0)


def _objective(train: Moments, gram: np.ndarray, b: np.ndarray, w: np.ndarray, alpha: float) -> float:
    return float((train.co[-1, -1] / train.n - 2 * w @ b + w @ gram @ w) / 2 + alpha * np.abs(w).sum())


def least_squares(train: Moments) -> Fit:
    """The shortest weights among those of least squared error, from the normal equations."""
    std, gram, b = _standard(train)
    w = np.linalg.pinv(gram, rcond=FLAT, hermitian=True) @ b
    return Fit(w, train.mean[-1], train.mean[:-1], std, b - gram @ w, (_objective(train, gram, b, w, 0.0),))


def lasso(train: Moments, alpha: float, sweeps: int = 10_000, tol: float = 1e-13) -> Fit:
    """Least squared error (halved) with an L1 penalty, by coordinate descent on the matrix."""
    std, gram, b = _standard(train)
    w, objective = np.zeros(len(b)), []
    for _ in range(sweeps):
        before = w.copy()
        for j in np.flatnonzero(np.diag(gram)):
            rho = b[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
        objective.append(_objective(train, gram, b, w, alpha))
        if np.abs(w - before).max(initial=0) <= tol:
            break
    return Fit(w, train.mean[-1], train.mean[:-1], std, b - gram @ w, tuple(objective))


def mse(fit: Fit, rows: Moments) -> float:
    """Mean squared error of a fit on rows of which only the moments are known."""
    slope = np.append(-fit.weights / fit.std, 1.0)  # of the label less its prediction
    bias = slope @ (rows.mean - np.append(fit.mean, fit.intercept))
    return float(slope @ rows.co @ slope / rows.n + bias**2)


def baseline_mse(train: Moments, rows: Moments, truncate: bool = True) -> float:
    """Error of always answering the training mean, without its fraction where truncated."""
    answer = float(int(train.mean[-1])) if truncate else train.mean[-1]
    return float(rows.co[-1, -1] / rows.n + (rows.mean[-1] - answer) ** 2)


def fit_rows(spark: SparkSession, fit: Fit, names: Sequence[str]) -> DataFrame:
    """(pos, feature, weight, gradient) of a fit.

    The gradient is the covariance of a feature with the residual: 0 after least
    squares; after a lasso the penalty with the weight's sign, and at most the
    penalty where the weight is 0.
    """
    rows = [(i, n, float(w), float(g)) for i, (n, w, g) in enumerate(zip(names, fit.weights, fit.gradient, strict=True))]
    return spark.createDataFrame(rows, "pos int, feature string, weight double, gradient double")


def objective_rows(spark: SparkSession, fit: Fit, every: int = 1, first: int | None = None) -> DataFrame:
    """(iteration, objective) after each sweep, or each `every`-th, from 0 on."""
    rows = [(i, v) for i, v in enumerate(fit.objective[:first]) if i % every == 0]
    return spark.createDataFrame(rows, "iteration int, objective double")


def compare(
    spark: SparkSession, train: Moments, valid: Moments, alpha: float = 0.1, truncate: bool = True
) -> DataFrame:
    """(model, mse) of the mean baseline, least squares and the lasso."""
    rows = [
        ("Baseline (Mean)", baseline_mse(train, valid, truncate)),
        ("Linear Regression", mse(least_squares(train), valid)),
        ("Lasso Regression", mse(lasso(train, alpha), valid)),
    ]
    return spark.createDataFrame(rows, "model string, mse double")


def compare_patterns(spark: SparkSession, patterns: Mapping[str, tuple[Moments, Moments]], alpha: float = 0.05) -> DataFrame:
    """(pattern, dims, active, mse) of one lasso per pattern of (train, valid)."""
    rows = []
    for name, (train, valid) in patterns.items():
        fit = lasso(train, alpha)
        rows.append((name, len(fit.weights), int((fit.weights != 0).sum()), mse(fit, valid)))
    return spark.createDataFrame(rows, "pattern string, dims int, active int, mse double")
