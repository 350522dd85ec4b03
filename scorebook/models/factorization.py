"""Factorisation machine over players, with numbers that enter linearly only.

A sample has a list of ids, in which an id may stand more than once, and a list
of numbers. Its prediction is bias + numbers · weights + the sum of its ids' own
weights + half of |sum of their vectors|² less the sum of |vector|²: numbers have
no vectors. Players' parameters are a table keyed by id. An epoch joins it with
the samples' ids, sums per sample, sums gradients per id and writes the next
table; only the bias, the numbers' weights and the error are on the driver. A
fit leaves the last parameters only: every write drops its shuffle files, and
what an epoch stored goes when the next one has read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.session import discard, materialized, shuffles_dropped


class Machine(NamedTuple):
    """`factors` holds (id, w, v0, v1, …); an id without a row counts as zeros."""

    bias: float
    weights: tuple[float, ...]
    factors: DataFrame
    size: int


class Fitted(NamedTuple):
    machine: Machine
    errors: tuple[float, ...]
    steps: tuple[float, ...]


def _v(size: int) -> list[str]:
    return [f"v{f}" for f in range(size)]


def _added(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def initial(ids: DataFrame, numbers: int, size: int, std: float = 0.01, seed: int = 42, bias: float = 0.0) -> Machine:
    """Small values for every id of a column `id`, the same on every run: they hang on id, place and seed only."""
    spread = std * 3**0.5 / 2**63  # uniform values of that deviation

    def value(place: int) -> Column:
        return F.xxhash64(F.col("id").cast("string"), F.lit(seed), F.lit(place)) * F.lit(spread)

    known = ids.select("id").where("id IS NOT NULL").distinct()
    factors = known.select("id", value(-1).alias("w"), *[value(f).alias(c) for f, c in enumerate(_v(size))])
    return Machine(bias, (0.0,) * numbers, materialized(factors, "factors"), size)


def sums(samples: DataFrame, machine: Machine, keys: Sequence[str], ids: str = "ids") -> DataFrame:
    """(keys, w, v0 …, squares): per sample the sums over its ids, each as often as it stands there."""
    v = _v(machine.size)
    entries = samples.select(*keys, F.explode_outer(ids).alias("id"))
    met = entries.join(machine.factors, "id", "left")
    squares = _added([F.col(c) * F.col(c) for c in v])
    return met.groupBy(*keys).agg(
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in v],
        F.coalesce(F.sum(squares), F.lit(0.0)).alias("squares"),
    )


def predict(samples: DataFrame, machine: Machine, keys: Sequence[str], ids: str = "ids", numbers: str = "numbers") -> DataFrame:
    """The samples with `prediction`; `keys` name one sample each, and another number of numbers is an error."""
    v, n = _v(machine.size), len(machine.weights)
    summed = sums(samples, machine, keys, ids).select(
        *keys, (F.col("w") + (_added([F.col(c) * F.col(c) for c in v]) - F.col("squares")) / 2).alias("_players")
    )
    linear = _added([F.col(numbers)[j].cast("double") * F.lit(w) for j, w in enumerate(machine.weights)])
    other = F.raise_error(F.lit(f"a sample has not {n} numbers")).cast("double")
    ready = F.when(F.size(numbers) != n, other).otherwise(linear)
    return samples.join(summed, list(keys)).withColumn("prediction", F.lit(machine.bias) + ready + F.col("_players")).drop("_players")


def _off(samples: DataFrame, machine: Machine, keys: Sequence[str], label: str) -> DataFrame:
    """(ids, numbers, e, s0 …): how far each prediction is off, and the sample's summed vectors."""
    v = _v(machine.size)
    summed = sums(samples, machine, keys)
    linear = _added([F.col("numbers")[j].cast("double") * F.lit(w) for j, w in enumerate(machine.weights)])
    players = F.col("w") + (_added([F.col(c) * F.col(c) for c in v]) - F.col("squares")) / 2
    off = (F.lit(machine.bias) + linear + players - F.col(label)).alias("e")
    return samples.join(summed, list(keys)).select("ids", "numbers", off, *[F.col(c).alias(f"s{f}") for f, c in enumerate(v)])


def _moved(off: DataFrame, machine: Machine, n: int, step: float, decay: float, n_numbers: int) -> Machine:
    """The machine after one step down the gradient of the mean squared error."""
    v = _v(machine.size)
    at_id = off.select(F.explode("ids").alias("id"), "e", *[(F.col("e") * F.col(f"s{f}")).alias(f"g{f}") for f in range(machine.size)])
    slopes = at_id.where("id IS NOT NULL").groupBy("id").agg(F.sum("e").alias("e"), *[F.sum(f"g{f}").alias(f"g{f}") for f in range(machine.size)])
    rate = F.lit(2.0 / n)
    # Along a vector: the others' sum, so an id's own vector is taken out once per place it stands in.
    pulls = [rate * (F.col(f"g{f}") - F.col("e") * F.col(c)) for f, c in enumerate(v)]
    zero = F.lit(0.0)

    def down(value: str, pull: Column) -> Column:
        return (F.col(value) - F.lit(step) * (F.coalesce(pull, zero) + F.lit(decay) * F.col(value))).alias(value)

    met = machine.factors.join(slopes, "id", "left")
    factors = met.select("id", down("w", rate * F.col("e")), *[down(c, p) for c, p in zip(v, pulls)])
    flat = off.agg(F.sum("e").alias("b"), *[F.sum(F.col("e") * F.col("numbers")[j]).alias(f"n{j}") for j in range(n_numbers)]).first()
    weights = tuple(w - step * (2.0 / n * flat[f"n{j}"] + decay * w) for j, w in enumerate(machine.weights))
    return Machine(machine.bias - step * 2.0 / n * flat["b"], weights, materialized(factors, "factors"), machine.size)


def fit(
    samples: DataFrame, keys: Sequence[str], numbers: int, size: int = 16, epochs: int = 100, step: float = 0.1,
    decay: float = 0.0, label: str = "runs", seed: int = 42,
) -> Fitted:
    """Fit a machine to samples (keys, ids, numbers, label) by steps over all of them; the error falls with every epoch.

    A step that would raise the penalised error is taken back and halved, so
    `step` is only where it starts. `errors` has the mean squared error before
    the first and after every epoch, `steps` the step of each.
    """
    with shuffles_dropped(samples.sparkSession):
        return _fit(samples, keys, numbers, size, epochs, step, decay, label, seed)


def _fit(
    samples: DataFrame, keys: Sequence[str], numbers: int, size: int, epochs: int, step: float, decay: float, label: str, seed: int
) -> Fitted:
    rows = samples.where(F.col(label).isNotNull()).select(*keys, "ids", "numbers", F.col(label).cast("double").alias(label))
    stored = materialized(rows, "fm-samples")
    n, mean = stored.agg(F.count(F.lit(1)), F.avg(label)).first()
    if not n:
        raise ValueError("no samples to fit")
    now = initial(stored.select(F.explode("ids").alias("id")), numbers, size, seed=seed, bias=mean)

    def judged(machine: Machine) -> tuple[DataFrame, float, float]:
        off = materialized(_off(stored, machine, keys, label), "off")
        error = off.agg(F.avg(F.col("e") * F.col("e"))).first()[0]
        penalty = 0.0
        if decay:
            squares = _added([F.col(c) * F.col(c) for c in ("w", *_v(size))])
            penalty = decay / 2 * (machine.factors.agg(F.sum(squares)).first()[0] or 0.0) + decay / 2 * sum(w * w for w in machine.weights)
        return off, error, error + penalty

    off, error, goal = judged(now)
    errors, steps = [error], []
    while len(steps) < epochs and step > 1e-9:
        moved = _moved(off, now, n, step, decay, numbers)
        next_off, next_error, next_goal = judged(moved)
        if next_goal >= goal:
            step /= 2
            discard(moved.factors)
            discard(next_off)
            continue
        discard(now.factors)
        discard(off)
        now, off, goal = moved, next_off, next_goal
        errors.append(next_error)
        steps.append(step)
    discard(off)
    discard(stored)
    return Fitted(now, tuple(errors), tuple(steps))


def error_rows(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """(epoch, step, mse): the error after every epoch, epoch 0 before the first."""
    rows = [(i, s, e) for i, (s, e) in enumerate(zip((0.0, *fitted.steps), fitted.errors))]
    return spark.createDataFrame(rows, "epoch int, step double, mse double")
