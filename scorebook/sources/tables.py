"""Season tables: CSV in, CSV out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.text import sentinel
from scorebook.sources.schemas import CANONICAL, TEXT_COLUMNS


def existing(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split paths into those that exist and those that are missing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found, missing = [], []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        (found if p.getFileSystem(conf).exists(p) else missing).append(path)
    return found, missing


def canonical(df: DataFrame, names: Mapping[str, str] = CANONICAL) -> DataFrame:
    """Internal column names; a byte-order mark left on the first header is dropped."""
    return df.toDF(*[names.get(c.lstrip("﻿"), c.lstrip("﻿")) for c in df.columns])


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files of a path, those with equal header lines together, in the order of their headers."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    heads = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found: dict[str, list[str]] = {}
    for row in heads.orderBy("header", "file").collect():
        found.setdefault(row.header.lstrip("\ufeff"), []).append(unquote(row.file))
    return list(found.values())


def read_table(
    spark: SparkSession, path: str | list[str], numeric: str = "double", text_columns: Sequence[str] = TEXT_COLUMNS
) -> DataFrame:
    """A season table with its header's columns, whatever they are.

    Columns outside `text_columns` are numbers. The read is of plain strings, so
    no pass over the data is spent on inference. Files with different headers
    are read header by header; a column that a file lacks is null there.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    groups = files_by_header(spark, path)
    raw = seasons(*[canonical(reader.csv(files)) for files in groups]) if len(groups) > 1 else canonical(reader.csv(path))
    return raw.select(
        *[
            F.col(f"`{c}`") if c in text_columns else F.col(f"`{c}`").try_cast(numeric).alias(c)
            for c in raw.columns
        ]
    )


def read_typed(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A table whose columns are known in advance; the header is checked against them."""
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    )


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; single_file is for tables known to be small."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def clean_pitcher_counts(df: DataFrame) -> DataFrame:
    """Pitcher counting table: a dash as ERA becomes the sentinel text."""
    return df.withColumn("era", sentinel(F.col("era")))


def seasons(*tables: DataFrame) -> DataFrame:
    """Seasons with different columns in one table; absent columns are null."""
    together = tables[0]
    for more in tables[1:]:
        together = together.unionByName(more, allowMissingColumns=True)
    return together
