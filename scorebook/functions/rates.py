"""Rate statistics and player types as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE_COLUMNS = ("type_power", "type_avg", "type_speed", "type_eye", "type_all")

# Pitch types by group.
PITCH_GROUPS = {
    "fast": ("ストレート", "ツーシーム", "ワンシーム"),
    "breaking": (
        "スライダー", "カットボール", "カーブ", "シュート", "スローカーブ",
        "ナックルカーブ", "スラーブ", "スローボール", "パワーカーブ", "高速スライダー",
    ),
    "falling": (
        "フォーク", "チェンジアップ", "シンカー", "スプリット", "縦スライダー",
        "パーム", "スクリュー",
    ),
}


@dataclass(frozen=True)
class Thresholds:
    """A player gets a flag when a figure is strictly above its threshold."""

    hr: float = 15
    slg: float = 0.400
    avg: float = 0.290
    sb: float = 10
    triples: float = 3
    isod: float = 0.08
    flags_for_all: int = 3


def with_rates(df: DataFrame, guard: str = "max1") -> DataFrame:
    """Add avg, obp, slg, ops and isod.

    guard="max1" divides by at least 1; guard="filter" drops players without an
    at-bat.
    """
    on_base = F.col("h") + F.col("bb") + F.col("hbp")
    chances = F.col("ab") + F.col("bb") + F.col("hbp") + F.col("sf")
    at_bats = F.col("ab")
    if guard == "filter":
        df = df.filter(F.col("ab") > 0)
    elif guard == "max1":
        at_bats, chances = F.greatest(at_bats, F.lit(1)), F.greatest(chances, F.lit(1))
    else:
        raise ValueError(f"unknown guard {guard!r}")
    avg, obp, slg = F.col("h") / at_bats, on_base / chances, F.col("tb") / at_bats
    return df.withColumns(
        {"avg": avg, "obp": obp, "slg": slg, "ops": obp + slg, "isod": obp - avg}
    )


def with_types(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add the five 0/1 type flags to a table that has rates."""
    flags = {
        "type_power": (F.col("hr") > limits.hr) | (F.col("slg") > limits.slg),
        "type_avg": F.col("avg") > limits.avg,
        "type_speed": (F.col("sb") > limits.sb) | (F.col("triples") > limits.triples),
        "type_eye": F.col("isod") > limits.isod,
    }
    ints = {name: flag.cast("int") for name, flag in flags.items()}
    total = reduce(lambda a, b: a + b, ints.values())
    return df.withColumns({**ints, "type_all": (total >= limits.flags_for_all).cast("int")})


def group_sum(df: DataFrame, members) -> Column:
    """Sum of the member columns that the table has; 0.0 when it has none."""
    present = [c for c in members if c in df.columns]
    return reduce(
        lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in present], F.lit(0.0)
    )


def share_column(pitch_type: str) -> str:
    return f"pitch_{pitch_type}_share"


def with_pitch_groups(df: DataFrame, groups=None) -> DataFrame:
    """Add one `<group>_group` column per pitch group; absent pitches are skipped."""
    groups = groups or {g: [share_column(t) for t in ts] for g, ts in PITCH_GROUPS.items()}
    return df.withColumns({f"{g}_group": group_sum(df, cols) for g, cols in groups.items()})


def relative_power(avg: Column, era: Column, missing_era: float = 4.0) -> Column:
    """Batting average against a tenth of the opposing starter's ERA."""
    return avg - F.coalesce(era, F.lit(missing_era)) / 10
