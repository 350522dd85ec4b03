"""Feature assembly: line-ups and opposing pitchers to flat vectors and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.text import BATTING_HANDS, THROWING_HANDS, encode_if_text
from scorebook.operators.lookup import keep_first, with_mean_default, with_zero_default
from scorebook.session import dealt

# Batter feature columns by pattern: raw figures, or hand and types.
BATTER_PATTERNS = {
    "rates": ("avg", "hr", "slg", "ops"),
    "full": ("hand", "avg", "hr", "slg", "ops"),
    "A": ("hand", "avg", "hr", "slg"),
    "B": ("hand", "type_power", "type_avg", "type_speed", "type_eye", "type_all"),
}
PITCHER_GROUPED = ("hand", "era", "k9", "hr9", "fast_group", "breaking_group", "falling_group")


def batter_columns(pattern: str) -> tuple[str, ...]:
    return BATTER_PATTERNS[pattern]


def prepare_batters(df: DataFrame) -> DataFrame:
    """Batter table with its hand as a number."""
    return df.withColumn("hand", encode_if_text(df, "hand", BATTING_HANDS))


def prepare_pitchers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Pitcher table with its hand as a number, the first row per (team, name)."""
    coded = df.withColumn("hand", encode_if_text(df, "hand", THROWING_HANDS))
    return keep_first(coded, ["team", "name"], order)


def feature_columns(df: DataFrame, keys: Sequence[str] = ("team", "name")) -> list[str]:
    """Every non-key column, in table order: the features of a table with open columns."""
    return [c for c in df.columns if c not in keys]


def line_up_slots(samples: DataFrame) -> DataFrame:
    """(game_id, team, slot, name) rows of samples that hold `players` arrays; slots start at 1."""
    return samples.select(
        "game_id", "team", F.posexplode("players").alias("_pos", "name")
    ).select("game_id", "team", (F.col("_pos") + 1).alias("slot"), "name")


def with_batters(
    slots: DataFrame, batters: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("team", "name")
) -> DataFrame:
    """Slots with their batter features; unknown batters read as zeros."""
    return with_zero_default(slots, batters, keys, cols)


def with_pitchers(
    teams: DataFrame, pitchers: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("opponent", "starter")
) -> DataFrame:
    """(game, team) rows with the opposing starter's features; unknown starters read as means."""
    table = pitchers.withColumnsRenamed({"team": "opponent", "name": "starter"})
    return with_mean_default(teams, table, list(keys), cols)


def _place(slot: int, col: str) -> str:
    return f"_{slot}_{col}"


def _wide(slots: DataFrame, cols: Sequence[str], k: int, rows: int = 0) -> DataFrame:
    """One row per complete (game, team) with a column per slot and feature.

    The rows travel to their (game, team) as they are and are read there in one
    sorted pass: an aggregate would widen every row, and hold the wide rows of
    a task in memory, before it has a second row to merge it with. `rows` as in `flat`.
    """
    ordered = Window.partitionBy("game_id", "team").orderBy("slot")
    side = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = {
        _place(i, c): F.max(F.when(F.col("slot") == i, F.col(c).cast("double"))).over(side)
        for i in range(1, k + 1)
        for c in cols
    }
    read = dealt(slots, rows, "game_id", "team").select(
        "game_id", "team", F.count(F.lit(1)).over(side).alias("_n"), F.row_number().over(ordered).alias("_at"),
        *[c.alias(name) for name, c in places.items()],
    )
    return read.filter((F.col("_n") == k) & (F.col("_at") == 1)).drop("_n", "_at")


def _assembled(slots: DataFrame, teams: DataFrame, batter_cols, pitcher_cols, k: int, rows: int, out: str, value) -> DataFrame:
    wide = _wide(slots, batter_cols, k, rows)
    made = [c for c in wide.columns if c.startswith("_")]
    return wide.join(teams, ["game_id", "team"]).withColumn(out, value).drop(*made, *pitcher_cols)


def flat(
    slots: DataFrame, teams: DataFrame, batter_cols: Sequence[str], pitcher_cols: Sequence[str], k: int = 9, rows: int = 0
) -> DataFrame:
    """One vector per (game, team): k batter vectors, then the pitcher vector.

    `slots` holds batter features per slot, `teams` one row per (game, team)
    with the pitcher features and any label columns. `rows`, where known, is
    the number of slots or more: large tables are dealt to more tasks by it.
    """
    batted = [F.col(_place(i, c)) for i in range(1, k + 1) for c in batter_cols]
    vec = F.array(*batted, *[F.col(c).cast("double") for c in pitcher_cols])
    return _assembled(slots, teams, batter_cols, pitcher_cols, k, rows, "vec", vec)


def sequence(
    slots: DataFrame, teams: DataFrame, batter_cols: Sequence[str], pitcher_cols: Sequence[str], k: int = 9, rows: int = 0
) -> DataFrame:
    """One sequence per (game, team): k steps of batter features followed by the pitcher's. `rows` as in `flat`."""
    pitcher = [F.col(c).cast("double") for c in pitcher_cols]
    seq = F.array(*[F.array(*[F.col(_place(i, c)) for c in batter_cols], *pitcher) for i in range(1, k + 1)])
    return _assembled(slots, teams, batter_cols, pitcher_cols, k, rows, "seq", seq)


# Names of features in the weight ranking.
FEATURE_LABELS = {
    "hand": "Hand", "type_power": "Power", "type_avg": "Average", "type_speed": "Speed", "type_eye": "Eye",
    "type_all": "All-Rounder",
}
PITCHER_LABELS = {
    "era": "ERA", "k9": "K/9", "hr9": "HR/9", "fast_group": "Fast_G", "breaking_group": "Break_G",
    "falling_group": "Fall_G",
}


def flat_names(batter_cols: Sequence[str], pitcher_cols: Sequence[str], k: int = 9) -> list[str]:
    """Names of the places of a flat vector: `<slot>番_<batter feature>`, then `P_<pitcher feature>`."""
    batted = [f"{i}番_{FEATURE_LABELS.get(c, c)}" for i in range(1, k + 1) for c in batter_cols]
    return batted + [f"P_{PITCHER_LABELS.get(c, c)}" for c in pitcher_cols]


def shape(samples: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: number of samples and their width."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.max(F.size(vec)).alias("width"))
