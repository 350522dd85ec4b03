"""Incremental ingest of game documents and running totals over a stream of plays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scorebook.functions.text import game_id_from_url
from scorebook.sources.games import CORRUPT
from scorebook.sources.schemas import GAME
from scorebook.streaming.store import KeyedStore


def game_stream(spark: SparkSession, path: str, multi_line: bool = True, tolerant: bool = False) -> DataFrame:
    """New game files as a stream.

    As in `games.read_games`, a file that is not a document is an error; when
    tolerant, it and documents without a scoreboard are left out.
    """
    reader = (
        spark.readStream.schema(T.StructType([*GAME.fields, T.StructField(CORRUPT, T.StringType())]) if tolerant else GAME)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*.json*")
        .option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    )
    if tolerant:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    games = reader.json(path)
    if tolerant:
        games = games.filter(F.col(CORRUPT).isNull() & F.col("scoreboard").isNotNull()).drop(CORRUPT)
    return games.withColumn("game_id", game_id_from_url(F.col("url")))


def _append_batch(store: str):
    """Write a micro-batch under its own number: a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return write


def _batch_writer(store: str | KeyedStore):
    return store.writer() if isinstance(store, KeyedStore) else _append_batch(store)


def ingest(stream: DataFrame, store: str | KeyedStore, checkpoint: str) -> StreamingQuery:
    """Take in everything that is new and stop; run again for later files.

    A keyed store is compacted as batches come in; a path collects the batches for `latest`.
    """
    return (
        stream.writeStream.foreachBatch(_batch_writer(store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, store: str, keys: Sequence[str]) -> DataFrame:
    """Stored rows, the newest batch per key."""
    stored = spark.read.option("basePath", store).parquet(store)
    cols = [c for c in stored.columns if c != "batch_id" and c not in keys]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def running_totals(plays: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals per key as streaming state; map tasks sum before the shuffle."""
    return plays.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def store_totals(totals: DataFrame, store: str | KeyedStore, checkpoint: str) -> StreamingQuery:
    """Write the keys each batch changed; read them back with `latest` or from the keyed store."""
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(_batch_writer(store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
