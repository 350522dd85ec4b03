"""Point-in-time running totals: what was known before each game."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from scorebook.functions.classify import MEASURES, deltas
from scorebook.operators.lookup import unique

# Sorts before every order key; carries the totals known at the start.
START = ""


def exclusive_totals(
    requests: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    initial: DataFrame | None = None,
    chunk_chars: int = 8,
    label: str | None = None,
) -> DataFrame:
    """Totals of `measures` per request over all changes with a smaller order key.

    `requests` holds keys and order; `changes` holds keys, order and measures;
    `initial` holds keys and measures known before the first order key. `order`
    is a string column. A key without changes gets zeros; rows without a key or
    an order are skipped. Totals are whole numbers unless a measure is not.
    `label` names a column of requests and changes that goes with the order key,
    one value for each; it comes out next to it.

    Rows are first summed to one per (keys, order). The history of a key is then
    cut into chunks by the first `chunk_chars` characters of the order key (a
    prefix never decreases along the order), so one busy key is spread over as
    many groups as it has chunks: totals inside a chunk plus totals of the
    chunks before it.
    """
    sources = [changes] if initial is None else [changes, initial]
    whole = all(isinstance(df.schema[m].dataType, IntegralType) for df in sources for m in measures)
    kind = "long" if whole else "double"
    zero = [F.lit(0).cast(kind).alias(m) for m in measures]
    values = [F.col(m).cast(kind).alias(m) for m in measures]
    at = [order] if label is None else [order, label]
    events = requests.select(*keys, *at, *zero, F.lit(1).alias("_asked")).unionByName(
        changes.select(*keys, *at, *values, F.lit(0).alias("_asked"))
    )
    if initial is not None:
        events = events.unionByName(
            initial.select(*keys, *[F.lit(START).alias(c) for c in at], *values, F.lit(0).alias("_asked"))
        )
    # Both uses of `steps` below read the same columns in the same order under the
    # same filters, so Spark computes its shuffle once and reuses it.
    steps = (
        events.withColumn("_chunk", F.substring(F.col(order), 1, chunk_chars))
        .filter(F.col("_chunk").isNotNull())
        .groupBy(*keys, "_chunk", *at)
        .agg(F.max("_asked").alias("_asked"), *[F.sum(m).alias(m) for m in measures])
    )

    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = steps.select(
        *keys, "_chunk", *at, "_asked",
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(m) for m in measures],
    ).filter("_asked = 1")
    per_chunk = steps.groupBy(*keys, "_chunk").agg(
        F.max("_asked").alias("_asked"), *[F.sum(m).alias(m) for m in measures]
    )
    before = per_chunk.select(
        *keys, "_chunk", "_asked",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
    ).filter("_asked = 1")
    return within.join(before.drop("_asked"), [*keys, "_chunk"]).select(
        *keys, *at, *[(F.col(m) + F.col(f"_before_{m}")).alias(m) for m in measures]
    )


def order_key(game_id: Column, order_by: str = "date") -> Column:
    """Replay order of games: by file name, or by date and then id."""
    if order_by == "file":
        return game_id
    if order_by == "date":
        return F.concat(F.regexp_extract(game_id, r"(\d{8})", 1), F.lit("-"), game_id)
    raise ValueError(f"unknown order {order_by!r}")


def credited(plays: DataFrame, credit: str = "batting") -> DataFrame:
    """One row per (play, team that gets the credit).

    `plays` holds the two scoreboard teams of the game as `visitor` and `home`
    and the half as `is_top`. "both" credits each of them, "last" only the home
    team, "batting" the team at bat.
    """
    if credit == "both":
        return plays.withColumn("team", F.explode(F.array("visitor", "home")))
    if credit == "last":
        return plays.withColumn("team", F.col("home"))
    if credit == "batting":
        return plays.withColumn("team", F.when(F.col("is_top"), F.col("visitor")).otherwise(F.col("home")))
    raise ValueError(f"unknown credit {credit!r}")


def changes(
    plays: DataFrame, rules: str = "literal", credit: str = "batting", order_by: str = "date", name: str = "name"
) -> DataFrame:
    """(_order, game_id, team, name) with what each play adds to the counting stats of those it is credited to."""
    played = credited(plays.filter(F.col(name).isNotNull()), credit).select(
        order_key(F.col("game_id"), order_by).alias("_order"),
        "game_id",
        "team",
        F.col(name).alias("name"),
        deltas(F.col("result"), rules).alias("_d"),
    )
    return played.select("_order", "game_id", "team", "name", *[F.col(f"_d.{m}").alias(m) for m in MEASURES])


def running_stats(
    requests: DataFrame,
    plays: DataFrame,
    initial: DataFrame | None = None,
    rules: str = "literal",
    credit: str = "batting",
    order_by: str = "date",
    chunk_chars: int | None = None,
    name: str = "name",
) -> DataFrame:
    """Counting stats of (team, name) before each requested game.

    `initial` holds one row per (team, name), a second one is an error; counting
    columns it lacks read as 0. Chunks are months unless `chunk_chars` says otherwise.

    `requests` holds (game_id, team, name); `plays` the columns of
    `games.plays`, of which `name` is the one that names the batter. Adds (ab, h, tb, hr, bb, hbp, sf) to the requests.
    """
    if chunk_chars is None:
        chunk_chars = len("cl202503") if order_by == "file" else len("202503")
    if initial is not None:
        absent = {m: F.lit(0) for m in MEASURES if m not in initial.columns}
        initial = unique(initial.withColumns(absent), ["team", "name"])
    asked = requests.select("game_id", "team", "name").distinct().withColumn(
        "_order", order_key(F.col("game_id"), order_by)
    )
    totals = exclusive_totals(
        asked, changes(plays, rules, credit, order_by, name), ["team", "name"], "_order", MEASURES, initial, chunk_chars, label="game_id"
    )
    return totals.select("game_id", "team", "name", *MEASURES)
