"""Aggregates with totals, rosters and score statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.rates import TYPE_COLUMNS


def score_stats(scores: DataFrame, col: str = "runs") -> DataFrame:
    """Count, mean, population deviation and variance (the error of always guessing the mean)."""
    return scores.agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
        F.var_pop(col).alias("variance"),
    )


def count_with_total(rows: DataFrame, key: str, total: str = "TOTAL") -> DataFrame:
    """Rows per key plus one total row; the roll-up runs over the counts, not the rows."""
    counts = rows.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    rolled = counts.rollup(key).agg(F.sum("n").alias("n"), F.grouping(key).alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), "n")


def type_members(players: DataFrame, types: Sequence[str] = TYPE_COLUMNS) -> DataFrame:
    """One row per (type, member); a player with several types appears once for each."""
    pairs = ", ".join(f"'{t}', {t}" for t in types)
    return (
        players.select("team", "name", F.expr(f"stack({len(types)}, {pairs}) as (type, flag)"))
        .filter("flag = 1")
        .select("type", "team", "name")
    )


def type_counts(players: DataFrame, types: Sequence[str] = TYPE_COLUMNS) -> DataFrame:
    return type_members(players, types).groupBy("type").agg(F.count(F.lit(1)).alias("members"))


def rosters(players: DataFrame, types: Sequence[str] = TYPE_COLUMNS) -> DataFrame:
    """Members with the size of their type, sorted by type, team and name."""
    counts = type_counts(players, types)  # one row per type
    return (
        type_members(players, types)
        .join(F.broadcast(counts), "type")
        .orderBy("type", "team", "name")
    )


def pivot_shares(
    shares: DataFrame, keys: Sequence[str], kind: str, share: str, kinds: Sequence[str],
    column=lambda k: f"pitch_{k}_share",
) -> DataFrame:
    """Long (key, kind, share) rows to one column per kind; a missing kind is 0."""
    wide = shares.groupBy(*keys).pivot(kind, list(kinds)).agg(F.max(share))
    return wide.select(
        *keys, *[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(column(k)) for k in kinds]
    )


def mse(df: DataFrame, label: str | Column, prediction: str | Column, out: str = "mse") -> DataFrame:
    label = F.col(label) if isinstance(label, str) else label
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    return df.agg(F.avg((label - prediction) * (label - prediction)).alias(out))


def report_lines(rows: DataFrame, fmt: str, cols: Sequence[str | Column], out: str = "line") -> DataFrame:
    """Add one formatted line per row; formats pad and never cut."""
    return rows.withColumn(out, F.format_string(fmt, *cols))
