"""Standardisation as an estimator whose statistics can be saved and applied to other data."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.operators import scaling

LAYOUTS = ("columns", "vector", "pooled")


class _Layout(Params):
    layout = Param(Params._dummy(), "layout", "columns, vector (one array) or pooled (an array of arrays)", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "the columns to scale; one for vector and pooled", TypeConverters.toListString)
    width = Param(Params._dummy(), "width", "length of the (inner) arrays", TypeConverters.toInt)

    def _chosen(self) -> tuple[str, list[str], int]:
        layout, columns = self.getOrDefault(self.layout), self.getOrDefault(self.columns)
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout!r}")
        if layout == "columns":
            return layout, columns, len(columns)
        if len(columns) != 1:
            raise ValueError(f"{layout} scales one column")
        return layout, columns, self.getOrDefault(self.width)


class Scaler(Estimator, _Layout, DefaultParamsReadable, DefaultParamsWritable):
    """Means and population deviations per column, per place of a vector, or per place over all steps of a sequence."""

    @keyword_only
    def __init__(self, *, layout: str = "columns", columns: list[str] | None = None, width: int = 0):
        super().__init__()
        self._setDefault(layout="columns", columns=[], width=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        layout, columns, width = self._chosen()
        if layout == "columns":
            scale = scaling.column_scale(dataset, columns).select(
                *[F.array(*[F.col(f"scale.{part}")[c] for c in columns]).alias(part) for part in ("mean", "std")]
            )
        else:
            steps = dataset.select(F.explode(columns[0]).alias("v")) if layout == "pooled" else dataset.select(F.col(columns[0]).alias("v"))
            scale = scaling.vector_scale(steps, "v", width).select("scale.mean", "scale.std")
        row = scale.first()
        if any(x is None for x in row["mean"]):
            raise ValueError("no rows to take statistics from")
        return ScalerModel(layout=layout, columns=columns, width=width, mean=list(row["mean"]), std=list(row["std"]))


class ScalerModel(Model, _Layout, DefaultParamsReadable, DefaultParamsWritable):
    """Saved statistics; a constant place has deviation 1 and becomes zeros on the data it was fitted on."""

    mean = Param(Params._dummy(), "mean", "means, in the order of the places", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "deviations, in the order of the places", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self, *, layout: str = "columns", columns: list[str] | None = None, width: int = 0,
        mean: list[float] | None = None, std: list[float] | None = None,
    ):
        super().__init__()
        self._setDefault(layout="columns", columns=[], width=0, mean=[], std=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layout, columns, width = self._chosen()
        mean, std = self.getOrDefault(self.mean), self.getOrDefault(self.std)
        if layout == "columns":
            return dataset.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, mean, std, strict=True)})

        def scaled(vec: Column) -> Column:
            means, stds = (F.array(*[F.lit(x) for x in xs]) for xs in (mean, std))
            other = F.raise_error(F.lit(f"a vector has not the length {width}")).cast("array<double>")
            values = F.transform(vec, lambda x, i: (x - F.get(means, i)) / F.get(stds, i))
            return F.when(F.size(vec) != width, other).otherwise(values)

        column = columns[0]
        return dataset.withColumn(column, scaled(F.col(column)) if layout == "vector" else F.transform(column, scaled))
