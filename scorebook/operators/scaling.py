"""Standardisation with population deviation, and the mean baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with structs `mean` and `std` (population; a constant column gets 1)."""
    std = {c: F.stddev_pop(F.col(c)) for c in cols}
    return df.agg(
        F.struct(
            F.struct(*[F.avg(F.col(c)).alias(c) for c in cols]).alias("mean"),
            F.struct(*[F.when(s > 0, s).otherwise(F.lit(1.0)).alias(c) for c, s in std.items()]).alias("std"),
        ).alias("scale")
    )


def standardized(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Columns minus mean over deviation; fitted on `fit`, or on `df` itself."""
    scale = column_scale(df if fit is None else fit, cols)
    ready = df.withColumn("_scale", scale.scalar())
    return ready.withColumns(
        {c: (F.col(c) - F.col("_scale.mean")[c]) / F.col("_scale.std")[c] for c in cols}
    ).drop("_scale")


def vector_scale(df: DataFrame, vec: str, width: int) -> DataFrame:
    """As `column_scale`, for an array column of fixed width: arrays `mean` and `std`."""
    other = F.raise_error(F.lit(f"a vector has not the length {width}")).cast("double")
    parts = [F.when(F.size(vec) != width, other).otherwise(F.col(vec)[i]) for i in range(width)]
    stds = [F.stddev_pop(p) for p in parts]
    return df.agg(
        F.struct(
            F.array(*[F.avg(p) for p in parts]).alias("mean"),
            F.array(*[F.when(s > 0, s).otherwise(F.lit(1.0)) for s in stds]).alias("std"),
        ).alias("scale")
    )


def _scaled(vec: Column, mean: Column, std: Column) -> Column:
    return F.transform(vec, lambda x, i: (x - F.get(mean, i)) / F.get(std, i))


def standardized_vector(df: DataFrame, vec: str, width: int, fit: DataFrame | None = None) -> DataFrame:
    scale = vector_scale(df if fit is None else fit, vec, width)
    ready = df.withColumn("_scale", scale.scalar())
    return ready.withColumn(vec, _scaled(F.col(vec), F.col("_scale.mean"), F.col("_scale.std"))).drop("_scale")


def standardized_sequence(df: DataFrame, seq: str, width: int, fit: DataFrame | None = None) -> DataFrame:
    """Standardise array<array<double>> with statistics pooled over all slots."""
    source = df if fit is None else fit
    pooled = vector_scale(source.select(F.explode(seq).alias("_step")), "_step", width)
    ready = df.withColumn("_scale", pooled.scalar())
    return ready.withColumn(
        seq, F.transform(seq, lambda step: _scaled(step, F.col("_scale.mean"), F.col("_scale.std")))
    ).drop("_scale")


def mean_baseline(train: DataFrame, valid: DataFrame, label: str, truncate: bool = True) -> DataFrame:
    """Validation rows with the training mean as prediction; truncate=True drops its fraction."""
    mean = train.agg(F.avg(label)).scalar()
    prediction = F.col("_mean").cast("int").cast("double") if truncate else F.col("_mean")
    return valid.withColumn("_mean", mean).withColumn("prediction", prediction).drop("_mean")
