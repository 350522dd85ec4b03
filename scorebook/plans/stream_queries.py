"""Streaming queries over the events table and its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.classify import MEASURES, deltas
from scorebook.plans import sql, table_queries, views
from scorebook.plans.registry import ORACLES, query
from scorebook.plans.views import table
from scorebook.session import scratch_path
from scorebook.sources import games, sinks
from scorebook.streaming import asof, ingest
from scorebook.streaming.store import KeyedStore


@query(
    "stream_ingest",
    "WITH " + sql.PLAYS + " SELECT game_id, slot, name, result, count(*) AS n FROM plays GROUP BY ALL",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, taken in by a stream, merged by their id and read back as plays."""
    inbox, store = scratch_path(spark, "inbox"), KeyedStore(spark, scratch_path(spark, "games"), ["game_id"])
    sinks.write_games(views.documents(spark, sf_dir).drop("game_id"), inbox)
    stream = ingest.game_stream(spark, inbox, multi_line=False)
    ingest.ingest(stream, store, scratch_path(spark, "ingest-checkpoint")).awaitTermination()
    store.compact()
    return (
        games.appearances(store.read())
        .groupBy(F.substring_index("game_id", "-", 1).alias("game_id"), "slot", "name", "result")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "stream_running_stats",
    "WITH " + sql.CLASSED + """
    SELECT CASE WHEN is_top THEN visitor ELSE home END AS team, name, CAST(sum(ab) AS BIGINT) AS ab,
      CAST(sum(h) AS BIGINT) AS h, CAST(sum(tb) AS BIGINT) AS tb, CAST(sum(hr) AS BIGINT) AS hr,
      CAST(sum(bb) AS BIGINT) AS bb, CAST(sum(hbp) AS BIGINT) AS hbp, CAST(sum(sf) AS BIGINT) AS sf
    FROM counted GROUP BY ALL""",
)
def stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per player as streaming state over the events table."""
    store = KeyedStore(spark, scratch_path(spark, "totals"), ["team", "name"])
    events = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    played = views.plays_of(events).select(
        F.when(F.col("is_top"), F.col("visitor")).otherwise(F.col("home")).alias("team"),
        "name",
        deltas(F.col("result"), "literal").alias("d"),
    )
    changes = played.select("team", "name", *[F.col(f"d.{m}").alias(m) for m in MEASURES])
    totals = ingest.running_totals(changes, ["team", "name"], MEASURES)
    ingest.store_totals(totals, store, scratch_path(spark, "totals-checkpoint")).awaitTermination()
    return store.read()


_FILES = 4


@query("stream_asof_stats", ORACLES["asof_running_stats"])
def stream_asof_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known before each game, from a stream of shuffled micro-batches in which many plays come twice.

    Plays are dealt to the files by hash, so every game is spread over all batches; a third
    of the plays stand in a second file too. Corrected figures replace earlier ones in a keyed store.
    """
    source = scratch_path(spark, "shuffled-events")
    events = table(spark, sf_dir, "events")
    once = F.pmod(F.xxhash64("event_id"), F.lit(_FILES)).cast("int")
    again = F.when(F.xxhash64(F.lit("again"), "event_id") % 3 == 0, F.array(once, (once + 1) % _FILES)).otherwise(F.array(once))
    dealt = events.withColumn("_file", F.explode(again)).repartitionByRange(_FILES, "_file").drop("_file")
    dealt.write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    played = views.plays_of(stream)
    team = F.when(F.col("is_top"), F.col("visitor")).otherwise(F.col("home"))
    days = played.select("name", team.alias("team"), F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))).alias("day"))
    asked = days.select("team", "name", F.concat(F.lit("cl"), F.date_format("day", "yyyyMMdd"), F.lit("01")).alias("game_id"))
    store = KeyedStore(spark, scratch_path(spark, "asof"), ["game_id", "team", "name"])
    found = asof.figures_before(asof.events(played, asked), table_queries.known_before(spark, sf_dir))
    with asof.map_state(spark):
        ingest.store_totals(found, store, scratch_path(spark, "asof-checkpoint")).awaitTermination()
    store.compact()
    return store.read().select("game_id", "team", "name", *MEASURES)
