"""Keyed lookups: defaults, duplicates, dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scorebook.operators.ordering import dense_index


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in `order`; each map task keeps one row per key before the shuffle."""
    return _keep(df, keys, order, lambda c: c.asc_nulls_first())


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in `order`: later writers win."""
    return _keep(df, keys, order, lambda c: c.desc_nulls_last())


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], direction) -> DataFrame:
    """One row per key by `order`; the other columns, in turn, part rows that tie there."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    by = [direction(F.col(f"`{c}`")) for c in [*order, *rest]]
    return group_rank(df, keys, by, 1, "_rank").drop("_rank")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; a second row of a key is an error when it is read."""
    same = Window.partitionBy(*keys)
    second = F.raise_error(F.concat_ws(" ", F.lit("more than one row for"), *[F.col(f"`{k}`").cast("string") for k in keys]))
    checked = F.when(F.count(F.lit(1)).over(same) > 1, second.cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_unique", checked).filter("_unique").drop("_unique")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; tables that must be unique give none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def with_zero_default(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Left lookup; a missing record reads as zeros, two records of a key are an error."""
    joined = left.join(unique(right.select(*keys, *cols), keys), list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with one struct of the column means."""
    return df.agg(F.struct(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]).alias("m"))


def with_mean_default(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Left lookup; a missing record reads as the column means of the table."""
    means = column_means(right, cols)
    marked = right.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols], F.lit(True).alias("_hit"))
    joined = left.join(marked, list(keys), "left").withColumn("_means", means.scalar())
    return joined.withColumns(
        {c: F.when(F.col("_hit"), F.col(c)).otherwise(F.col("_means")[c]) for c in cols}
    ).drop("_hit", "_means")


def known_names(left: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in `names`."""
    return left.join(names.select(*keys).distinct(), list(keys), "left_semi")


def last_source_wins(sources: Sequence[DataFrame], key: str, value: str, order: str) -> DataFrame:
    """Key to value over ordered sources: a later source, then a later row, overwrites."""
    ranked = [
        s.select(F.col(key), F.col(value), F.lit(i).alias("_source"), F.col(order).alias("_order"))
        for i, s in enumerate(sources)
    ]
    together = ranked[0]
    for more in ranked[1:]:
        together = together.unionByName(more)
    return together.groupBy(key).agg(F.max_by(value, F.struct("_source", "_order")).alias(value))


def id_dictionary(*names: DataFrame) -> DataFrame:
    """Dense 0-based ids of the distinct values in name order; each input has one column."""
    columns = [n.select(F.col(f"`{n.columns[0]}`").alias("name")) for n in names]
    together = columns[0]
    for more in columns[1:]:
        together = together.unionByName(more)
    return dense_index(together.filter("name is not null").distinct(), ["name"], "id")


def with_opponent(
    teams: DataFrame, game: str, team: str, pos: str, carry: Sequence[str] = (), out: str = "opponent"
) -> DataFrame:
    """Add the first other team of the same game, with its `carry` columns as `<out>_<column>`.

    `teams` holds one row per (game, team), so the window spans the teams of one
    game, of which only the first two can be an opponent. Games of one team drop out.
    """
    whole = Window.partitionBy(game).orderBy(pos, team).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    entry = F.struct(team, *carry)
    rows = teams.withColumns(
        {"_first": F.first(entry).over(whole), "_second": F.nth_value(entry, 2).over(whole)}
    )
    own_first = F.col("_first")[team] == F.col(team)
    rows = rows.withColumn("_other", F.when(own_first, F.col("_second")).otherwise(F.col("_first")))
    carried = {f"{out}_{c}": F.col("_other")[c] for c in carry}
    return (
        rows.withColumns({out: F.col("_other")[team], **carried})
        .filter(F.col(out).isNotNull())
        .drop("_first", "_second", "_other")
    )


def unique_prefix_match(
    short: DataFrame, full: DataFrame, team: str, short_name: str, full_name: str
) -> DataFrame:
    """Full name of each (team, short name) that starts exactly one full name.

    Full names are turned into their prefixes of the lengths that short names
    have and counted per (team, prefix), so the match is an equi-join of unique
    rows. The set of lengths cannot exceed the length of the longest name.
    """
    asked = short.select(team, F.col(short_name).alias("_prefix")).distinct()
    lengths = asked.agg(F.collect_set(F.length("_prefix"))).scalar()
    starts = (
        full.select(team, F.col(full_name).alias("_full"))
        .distinct()
        .withColumn("_lengths", lengths)
        .withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_full"))))
        .withColumn("_prefix", F.substring(F.col("_full"), F.lit(1), F.col("_n")))
        .groupBy(team, "_prefix")
        .agg(F.count(F.lit(1)).alias("_hits"), F.min("_full").alias("_full"))
        .filter("_hits = 1")
    )
    return asked.join(starts, [team, "_prefix"]).select(
        team, F.col("_prefix").alias(short_name), F.col("_full").alias(full_name)
    )


def league_average(df: DataFrame, labels: dict[str, str], method: str = "mean") -> DataFrame:
    """One row of column averages with the given text labels.

    method="mean" skips nulls; method="sum" divides sums by the row count.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if method == "mean":
        values = [F.avg(F.col(f"`{c}`")).alias(c) for c in numeric]
    elif method == "sum":
        values = [(F.sum(F.col(f"`{c}`")) / F.count(F.lit(1))).alias(c) for c in numeric]
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.agg(*values).select(*[F.lit(v).alias(k) for k, v in labels.items()], *[F.col(f"`{c}`") for c in numeric])


def append_league_row(df: DataFrame, labels: dict[str, str], method: str = "mean") -> DataFrame:
    """The table with its league-average row added; numbers become doubles."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    widened = df.select(
        *[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns]
    )
    return widened.unionByName(league_average(df, labels, method), allowMissingColumns=True)


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], top: int, out: str = "rank") -> DataFrame:
    """The first `top` rows per group with their rank; map tasks already cut to `top`."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= top)
