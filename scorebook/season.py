"""From game documents and season tables to samples, models and reports.

These functions string the operators together the way a season is analysed:
read the documents once, land them as tables (`landing.land`), then build
features from these. Documents that are not landed are taken as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.functions.rates import relative_power, with_rates, with_types
from scorebook.functions.text import map_codes
from scorebook.operators import affinity, features, lookup, running, summary
from scorebook.sources import games as docs
from scorebook.sources.landing import Landed

Games = DataFrame | Landed


def _samples(games: Games, k: int | None) -> DataFrame:
    return games.samples(k) if isinstance(games, Landed) else docs.samples(games, k)


def _plays(games: Games) -> DataFrame:
    return games.plays() if isinstance(games, Landed) else docs.plays(games)


def _appearances(games: Games) -> DataFrame:
    return games.appearances() if isinstance(games, Landed) else docs.appearances(games)


def _slots(games: Games, k: int) -> DataFrame:
    return games.slots(k) if isinstance(games, Landed) else features.line_up_slots(docs.samples(games, k))


def count_appearances(games: Games, with_total: bool = True) -> DataFrame:
    """Plate appearances per game, with a TOTAL row unless told otherwise."""
    counted = _appearances(games)
    if with_total:
        return summary.count_with_total(counted, "game_id")
    return counted.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))


def appearance_report(games: Games) -> DataFrame:
    """Report lines (line_no, game_id, line): games, a rule, the number of games, the total."""
    per_game = count_appearances(games, with_total=False)
    body = per_game.select(
        F.lit(0).alias("line_no"), "game_id", F.format_string("%s.json: %d打席", "game_id", "n").alias("line")
    )
    known = games.games() if isinstance(games, Landed) else games.select("game_id").distinct()
    sums = known.join(per_game, "game_id", "left").agg(
        F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )
    tail = F.array(
        F.lit("-" * 40), F.format_string("対象ファイル数: %d", "games"), F.format_string("総打席数: %d", "total")
    )
    end = sums.select(F.posexplode(tail).alias("_i", "line")).select(
        (F.col("_i") + 1).alias("line_no"), F.lit(None).cast("string").alias("game_id"), "line"
    )
    return body.unionByName(end)


def classified_batters(batters: DataFrame) -> DataFrame:
    """Batters with at-bats: rates and type flags, ready to write as a table."""
    return with_types(with_rates(batters, guard="filter")).select(
        "team", "name", "hand", "avg", "hr", "slg", "sb", "isod",
        "type_power", "type_avg", "type_speed", "type_eye", "type_all",
    )


def season_samples(
    games: Games, batters: DataFrame, pitchers: DataFrame, pattern: str = "A",
    pitcher_cols: Sequence[str] = features.PITCHER_GROUPED, layout: str = "flat", k: int = 9,
    with_power: bool = False,
) -> DataFrame:
    """Samples from fixed season tables: line-up figures and the opposing starter's.

    `batters` holds the columns of the pattern with a numeric hand, `pitchers`
    one row per (team, name). layout is "flat" (column vec) or "sequence"
    (column seq). with_power adds each batter's average against the starter's
    ERA as a last batter feature; the pattern must hold avg.
    """
    samples = _samples(games, k)
    cols = features.batter_columns(pattern)
    slots = features.with_batters(_slots(games, k), batters, cols)
    if with_power:
        era = pitchers.select(F.col("team").alias("opponent"), F.col("name").alias("starter"), "era")
        faced = samples.join(era, ["opponent", "starter"], "left")
        slots = slots.join(faced.select("game_id", "team", "era"), ["game_id", "team"]).withColumn(
            "power", relative_power(F.col("avg"), F.col("era"))
        )
        cols = (*cols, "power")
    teams = features.with_pitchers(samples.drop("players"), pitchers, pitcher_cols)
    return _laid_out(slots, teams, cols, pitcher_cols, layout, k)


def running_samples(
    games: Games, initial: DataFrame, pitchers: DataFrame | None = None, pitcher_cols: Sequence[str] = (),
    rules: str = "literal", credit: str = "both", order_by: str = "file", layout: str = "sequence", k: int = 9,
    name: str = "token",
) -> DataFrame:
    """Samples from figures as they stood before each game: avg, hr, slg, ops per slot.

    `name` says how a play names its batter: by the "token" after the first
    space, or by the full "name" of a well-formed line.

    With `pitchers`, the opposing starter's columns follow each batter's (and
    the batter's hand leads them when `initial` holds a numeric one).
    """
    samples = _samples(games, k)
    slots = _slots(games, k)
    before = running.running_stats(slots, _plays(games), initial, rules, credit, order_by, name=name)
    rated = with_rates(before, "max1").select("game_id", "team", "name", *features.BATTER_PATTERNS["rates"])
    cols = features.BATTER_PATTERNS["rates"]
    filled = slots.join(rated, ["game_id", "team", "name"])
    if pitchers is None:
        teams, pitcher_cols = samples.drop("players"), ()
    else:
        teams = features.with_pitchers(samples.drop("players"), pitchers, pitcher_cols)
        if "hand" in initial.columns:
            cols = features.BATTER_PATTERNS["full"]
            filled = lookup.with_zero_default(filled, initial, ["team", "name"], ["hand"])
    return _laid_out(filled, teams, cols, pitcher_cols, layout, k)


def _laid_out(slots, teams, cols, pitcher_cols, layout: str, k: int) -> DataFrame:
    if layout == "flat":
        return features.flat(slots, teams, cols, pitcher_cols, k)
    if layout == "sequence":
        return features.sequence(slots, teams, cols, pitcher_cols, k)
    raise ValueError(f"unknown layout {layout!r}")


def affinity_listing(
    hitters: DataFrame, pitchers: DataFrame, ids: DataFrame, factors: DataFrame, top: int
) -> DataFrame:
    """Ranked pitchers per hitter from named players, their ids and factor vectors.

    `hitters` and `pitchers` hold (name, team, line) in file order, `ids` (name,
    id), `factors` (id, v). A name's team is the one of its last row, pitchers
    after hitters; teams are compared by their codes.
    """
    teams = lookup.last_source_wins([hitters, pitchers], "name", "team", "line").select(
        "name", map_codes(F.col("team")).alias("team")
    )
    vectors = ids.join(factors, "id").join(teams, "name").select("name", "team", "v")

    def side(players: DataFrame, name: str, prefix: str) -> DataFrame:
        known = players.select("name").distinct().join(vectors, "name")
        return known.select(
            F.col("name").alias(name), F.col("team").alias(f"{prefix}_team"), F.col("v").alias(f"{prefix}_vec")
        )

    return affinity.rank(side(hitters, "hitter", "h"), side(pitchers, "pitcher", "p"), top)
