"""What was known before each game, kept up to date on a stream.

Plays and requests arrive in any order and any number of micro-batches. The
state of a (team, name) holds the plays by month, game and id, and the sums of
each game. A batch changes some games; the figures before every later game
that was asked for come out anew, so a game that comes late corrects what was
said before. A play that is delivered again changes nothing, one that is
delivered with another result takes the place of the first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scorebook.functions.classify import MEASURES, deltas
from scorebook.operators import running

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONGS = ", ".join(f"{m} long" for m in MEASURES)
# Characters of the order key that name the chunk a play is kept in: a month in order of dates.
CHUNK_CHARS = 6
OUTPUT = f"team string, name string, game_id string, {_LONGS}"


@contextmanager
def map_state(spark: SparkSession):
    """A session whose streams started meanwhile keep map state, which asks for the RocksDB store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield spark
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def changed(plays: dict[int, Sequence[int]], rows: Sequence[Mapping]) -> bool:
    """Take a game's rows into its plays; whether any of them was new or different."""
    before = dict(plays)
    plays.update({r["event_id"]: [r[m] for m in MEASURES] for r in rows})
    return plays != before


class FiguresBefore(StatefulProcessor):
    """Per (team, name): plays by game and event, kept by chunk, and all games' sums with who was asked for.

    A call to the state store costs more than what it carries, and so does every
    cell of a row of state: a batch reads and writes a player's games at once and
    its plays by the chunk, each as one JSON text.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plays = handle.getMapState("plays", "chunk string", "plays string")
        self.games = handle.getValueState("games", "games string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep({running.START: [None, False, *[int(initialState[m] or 0) for m in MEASURES]]})

    def _known(self) -> dict[str, list]:
        """By order key: game id, whether it was asked for, sums."""
        held = self.games.get()
        return {} if held is None else json.loads(held[0])

    def _keep(self, games: dict[str, list]) -> None:
        self.games.update((json.dumps(games),))

    def _chunk(self, chunk: str) -> dict[str, dict[int, list[int]]]:
        """Plays of a chunk by order key and id."""
        held = self.plays.getValue((chunk,))
        return {} if held is None else {at: {int(i): c for i, c in plays.items()} for at, plays in json.loads(held[0]).items()}

    def _keep_chunk(self, chunk: str, plays: dict[str, dict[int, list[int]]]) -> None:
        self.plays.updateValue((chunk,), (json.dumps(plays),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        by_game: dict[str, list[Row]] = {}
        for row in rows:
            by_game.setdefault(row.at, []).append(row)
        games, chunks = self._known(), {}
        earliest, asked_now, touched, moved = None, set(), False, set()
        for at, of_game in by_game.items():
            game = games.setdefault(at, [of_game[0].game_id, False, *[0] * len(MEASURES)])
            if any(r.play is None for r in of_game) and not game[1]:
                game[1], touched = True, True
                asked_now.add(at)
            played = [json.loads(r.play) for r in of_game if r.play is not None]
            if played:
                chunk = at[:CHUNK_CHARS]
                if chunk not in chunks:
                    chunks[chunk] = self._chunk(chunk)
                plays = chunks[chunk].setdefault(at, {})
                if changed(plays, played):
                    moved.add(chunk)
                    game[2:] = [sum(c) for c in zip(*plays.values())]
                    earliest = at if earliest is None else min(earliest, at)
                    touched = True
        for chunk in moved:
            self._keep_chunk(chunk, chunks[chunk])
        if touched:
            self._keep(games)
        sums = [0] * len(MEASURES)
        for at in sorted(games):
            game = games[at]
            if game[1] and (at in asked_now or (earliest is not None and at > earliest)):
                yield Row(team=key[0], name=key[1], game_id=game[0], **dict(zip(MEASURES, sums)))
            sums = [a + b for a, b in zip(sums, game[2:])]

    def close(self) -> None:
        pass


def events(plays: DataFrame, requests: DataFrame | None = None, rules: str = "literal", credit: str = "batting", order_by: str = "date",
           event_id: str = "event_id") -> DataFrame:
    """Plays, and requests (game_id, team, name) where given, as the rows that `figures_before` takes.

    `plays` holds the columns of `games.plays` and an id per play. A row carries its play as
    one JSON text, since every cell has its cost on the way to Python; a request has none.
    """
    played = running.credited(plays.where("name IS NOT NULL"), credit).select(
        "team", "name", "game_id", F.col(event_id).cast("long").alias("event_id"), deltas(F.col("result"), rules).alias("_d")
    )
    play = F.to_json(F.struct("event_id", *[F.col(f"_d.{m}").cast("long").alias(m) for m in MEASURES]), {"ignoreNullFields": "false"})
    rows = played.select("team", "name", "game_id", F.when(F.col("event_id").isNotNull(), play).alias("play"))
    if requests is not None:
        rows = rows.unionByName(requests.select("team", "name", "game_id", F.lit(None).cast("string").alias("play")))
    return rows.withColumn("at", running.order_key(F.col("game_id"), order_by))


def figures_before(rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(team, name, game_id) with the totals before that game, each time they are first asked for or change.

    `rows` is a stream of `events`; `initial` holds one row per (team, name). A
    player's sums are read once per batch and player, its plays only for the
    months of the batch. Start the stream within `map_state`.
    """
    first = None
    if initial is not None:
        absent = {m: F.lit(0) for m in MEASURES if m not in initial.columns}
        first = initial.withColumns(absent).select("team", "name", *MEASURES).groupBy("team", "name")
    return rows.where("at IS NOT NULL AND team IS NOT NULL").groupBy("team", "name").transformWithState(
        FiguresBefore(), OUTPUT, "Update", "None", initialState=first
    )
