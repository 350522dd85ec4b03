"""Writers: game documents, id dictionaries, text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_games(games: DataFrame, path: str, per_game: bool = False, max_records: int = 100_000) -> None:
    """Documents as JSON lines; per_game=True gives every game id its own folder instead.

    Many small files are slow to read back, so per_game is for hand-over to
    readers that want one file per game.
    """
    writer = games.write.mode("overwrite").option("maxRecordsPerFile", max_records)
    if per_game:
        writer = writer.partitionBy("game_id")
    writer.json(path)


def write_dictionary(ids: DataFrame, path: str, fmt: str = "parquet") -> None:
    """(name, id) rows as Parquet or, for readers outside Spark, as JSON lines."""
    ids.select("name", "id").write.mode("overwrite").format(fmt).save(path)


def read_dictionary(spark: SparkSession, path: str, inverted: bool = False, fmt: str = "parquet") -> DataFrame:
    """(name, id), or (id, name) when inverted."""
    ids = spark.read.format(fmt).schema("name string, id bigint").load(path)
    return ids.select("id", "name") if inverted else ids.select("name", "id")


def write_report(lines: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """Text lines in the given order: files in name order, lines in file order."""
    ordered = lines.orderBy(*order)
    ordered.select(F.col(line).alias("value")).write.mode("overwrite").text(path)
