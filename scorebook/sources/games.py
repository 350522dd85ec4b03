"""Game documents: reading them, and the flat views the operators work on.

All views of one document are array expressions on its own row, so none of
them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions import text
from scorebook.sources.schemas import GAME

CORRUPT = "_corrupt_record"


def read_games(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, tolerant: bool = False
) -> DataFrame:
    """Game documents with `game_id` (the file name without its ending).

    multi_line=True reads one document per file, False one per line; documents
    read by line take their id from the url. A file that is not a document is
    an error; when tolerant, it and documents without a scoreboard are left out.
    """
    schema = T.StructType([*GAME.fields, T.StructField(CORRUPT, T.StringType())]) if tolerant else GAME
    reader = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*.json*")
        .option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    )
    if tolerant:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    file_id = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    games = reader.json(path)
    if tolerant:
        games = games.filter(F.col(CORRUPT).isNull() & F.col("scoreboard").isNotNull()).drop(CORRUPT)
    return games.withColumn("game_id", file_id if multi_line else text.game_id_from_url(F.col("url")))


def _team(col: Column) -> Column:
    return text.normalize_team(col)


def scores(games: DataFrame) -> DataFrame:
    """(game_id, pos, team, runs); runs may be written in full-width digits."""
    return games.select("game_id", F.posexplode("scoreboard").alias("pos", "_s")).select(
        "game_id", "pos", _team(F.col("_s.team")).alias("team"), text.fullwidth_int(F.col("_s.R")).alias("runs")
    )


def readable_scores(games: DataFrame) -> DataFrame:
    """As `scores`, but a score that is no number also ends its game's list there."""
    parsed = F.transform("scoreboard", lambda s: text.fullwidth_int(s["R"]))
    prefix = games.withColumn("_runs", parsed).select(
        "game_id",
        F.posexplode(
            F.filter(
                F.transform("_runs", lambda r, i: F.struct(i.alias("pos"), r.alias("runs"))),
                lambda x: ~F.exists(
                    F.slice(F.col("_runs"), F.lit(1), x["pos"] + 1), lambda r: r.isNull()
                ),
            )
        ).alias("_i", "_x"),
    )
    return prefix.select("game_id", "_x.pos", "_x.runs")


def plays(games: DataFrame) -> DataFrame:
    """One row per play: position, inning, half, slot, name, result, both teams.

    `name` is null when the line is not `<n>番 <name>`; `token` is the second
    space-separated part of the line, which needs no such form.
    """
    entry = games.select(
        "game_id",
        _team(F.get("scoreboard", F.lit(0))["team"]).alias("visitor"),
        _team(F.get("scoreboard", F.lit(1))["team"]).alias("home"),
        F.posexplode("text_live").alias("entry_pos", "_e"),
    )
    play = entry.filter("_e.plays is not null").select(
        "game_id", "visitor", "home", "entry_pos", F.col("_e.inning").alias("inning"),
        F.posexplode("_e.plays").alias("play_pos", "_p"),
    )
    line, result = F.get("_p.lines", F.lit(0)), F.get("_p.lines", F.lit(1))
    return play.select(
        "game_id", "visitor", "home", "entry_pos", "play_pos", "inning",
        text.inning_number(F.col("inning")).alias("inning_no"),
        text.inning_is_top(F.col("inning")).alias("is_top"),
        text.batting_slot(line).alias("slot"),
        text.batting_name(line).alias("name"),
        text.second_token(line).alias("token"),
        result.alias("result"),
    )


def appearances(games: DataFrame) -> DataFrame:
    """Plays that count as a plate appearance: in an inning, with a slot, a name and a result."""
    return counted(plays(games))


def counted(played: DataFrame) -> DataFrame:
    """The plays that count as a plate appearance."""
    return played.filter(
        F.col("inning").contains("回") & F.col("name").isNotNull() & F.col("result").isNotNull()
    )


def _pregame(field: str) -> Column:
    entries = F.filter("text_live", lambda e: e["pregame"][field].isNotNull())
    return F.flatten(F.transform(entries, lambda e: e["pregame"][field]))


def samples(games: DataFrame, k: int | None = 9) -> DataFrame:
    """One row per (game, scoreboard team): runs, opponent, its starter, own players.

    The last line-up or starter entry of a team wins. k keeps complete line-ups
    only; k=None keeps all.
    """
    rows = games.select(
        "game_id",
        "scoreboard",
        _pregame("lineups").alias("_lineups"),
        _pregame("pitchers").alias("_pitchers"),
        F.posexplode("scoreboard").alias("pos", "_s"),
    ).withColumns({"team": _team(F.col("_s.team")), "runs": text.fullwidth_int(F.col("_s.R"))})
    teams = F.transform("scoreboard", lambda s: _team(s["team"]))
    rows = rows.withColumn("opponent", F.get(F.filter(teams, lambda t: t != F.col("team")), F.lit(0)))
    own = F.filter("_lineups", lambda e: _team(e["team"]) == F.col("team"))
    theirs = F.filter("_pitchers", lambda e: _team(e["team"]) == F.col("opponent"))
    rows = rows.withColumns(
        {
            "players": F.coalesce(F.try_element_at(own, F.lit(-1))["players"], F.array().cast("array<string>")),
            "starter": F.coalesce(F.try_element_at(theirs, F.lit(-1))["name"], F.lit(text.UNKNOWN_NAME)),
        }
    )
    if k is not None:
        rows = rows.filter(F.size("players") == k)
    return rows.select("game_id", "pos", "team", "runs", "opponent", "starter", "players")


def names(games: DataFrame) -> DataFrame:
    """Distinct player names of line-ups and plays."""
    listed = samples(games, None).select(F.explode("players").alias("name"))
    batted = plays(games).filter("name is not null").select("name")
    return listed.unionByName(batted).distinct()


def has_plays(games: DataFrame) -> DataFrame:
    """Documents that hold at least one entry with plays."""
    return games.filter(F.exists("text_live", lambda e: e["plays"].isNotNull()))
