"""Games landed once as bucketed, sorted tables, so that no later step parses a document or shuffles for its joins.

`land` writes the flat views of documents as Parquet tables under a path, in
buckets of the columns they are joined by; `opened` finds them again in any
session from the note beside them. `put` adds a season table in the same
buckets: line-up places and season figures then meet on (team, name), and
samples on (game_id, team), without an exchange.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.sources import games as docs
from scorebook.sources.generations import PART, Generations

BUCKETS = 32
BY_GAME, BY_SIDE, BY_PLAYER = ("game_id",), ("game_id", "team"), ("team", "name")


class Landed:
    """Tables under a path: each with its bucket columns; opened through the session's catalog."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # The notes switch in one step: a table that was written again is read from its new folder.
        self._notes = Generations(spark, f"{self.path}/notes")

    def _listed(self) -> dict[str, dict]:
        notes = self._notes.manifest()
        return {r.name: r.asDict() for r in self._notes.read().collect()} if notes.schema else {}

    def put(self, name: str, df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, sort: Sequence[str] = ()) -> None:
        """Write a table in buckets of `keys`, each sorted by them and then by `sort`; an earlier one of that name is replaced.

        Rows are dealt by the keys first, so every bucket is one file and keeps its order.
        """
        folder = f"{self.path}/{name}-{uuid.uuid4().hex}"
        table = f"scorebook_{uuid.uuid4().hex}"
        order = [*keys, *sort]
        dealt = df.repartition(buckets, *keys)
        dealt.write.bucketBy(buckets, *keys).sortBy(*order).format("parquet").option("path", folder).saveAsTable(table)
        note = (name, folder.removeprefix(f"{self.path}/"), self.spark.table(table).schema.json(), buckets, json.dumps(list(keys)), json.dumps(order))
        self.spark.sql(f"DROP TABLE {table}")  # external: the files stay
        kind = f"name string, folder string, schema string, buckets int, keys string, sort string, {PART} string"
        self._notes.replace(self.spark.createDataFrame([(*note, name)], kind))

    def names(self) -> list[str]:
        return sorted(self._listed())

    def table(self, name: str) -> DataFrame:
        """A landed table, known to Spark with its buckets and their order."""
        note = self._listed().get(name)
        if note is None:
            raise FileNotFoundError(f"{self.path} holds no table {name!r}")
        table = f"scorebook_{note['folder'].replace('-', '_')}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(note["schema"])).fields)
            quoted = {k: ", ".join(f"`{c}`" for c in json.loads(note[k])) for k in ("keys", "sort")}
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({quoted['keys']}) SORTED BY ({quoted['sort']}) "
                f"INTO {note['buckets']} BUCKETS LOCATION '{self.path}/{note['folder']}'"
            )
        return self.spark.table(table)

    def plays(self) -> DataFrame:
        """As `games.plays`."""
        return self.table("plays")

    def appearances(self) -> DataFrame:
        return docs.counted(self.plays())

    def scores(self) -> DataFrame:
        """As `games.scores`."""
        return self.table("scores")

    def games(self) -> DataFrame:
        """The ids of all games, of those without plays too."""
        return self.table("games")

    def samples(self, k: int | None = 9) -> DataFrame:
        """As `games.samples`."""
        found = self.table("samples")
        return found if k is None else found.where(F.size("players") == k)

    def slots(self, k: int | None = 9) -> DataFrame:
        """(game_id, team, slot, name) of line-ups of k players, in buckets of (team, name)."""
        found = self.table("slots")
        return (found if k is None else found.where(F.col("of") == k)).drop("of")


def land(games: DataFrame, path: str, buckets: int = BUCKETS) -> Landed:
    """Write plays, samples, line-up places and scores of documents, and open them."""
    landed = Landed(games.sparkSession, path)
    samples = docs.samples(games, None)
    landed.put("samples", samples, BY_SIDE, buckets)
    written = landed.table("samples")
    slots = written.select("game_id", "team", F.size("players").alias("of"), F.posexplode("players").alias("_i", "name"))
    landed.put("slots", slots.select("game_id", "team", (F.col("_i") + 1).alias("slot"), "name", "of"), BY_PLAYER, buckets)
    landed.put("plays", docs.plays(games), BY_GAME, buckets, ["entry_pos", "play_pos"])
    landed.put("scores", docs.scores(games), BY_GAME, buckets, ["pos"])
    landed.put("games", games.select("game_id").distinct(), BY_GAME, buckets)
    return landed


def opened(spark: SparkSession, path: str) -> Landed:
    return Landed(spark, path)
