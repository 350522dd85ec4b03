"""Order-dependent line-up operators on flat (game, team, name, position) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.operators.lookup import group_rank

SLOTS = 9


def first_k_distinct(
    rows: DataFrame, group: Sequence[str], name: str, order: Sequence[str], k: int = SLOTS
) -> DataFrame:
    """First k distinct names per group in row order, as (group…, slot, name, order…).

    Rows of equal order are read in name order. Repeats are merged by an
    aggregate and each map task keeps k names per group, so a busy group never
    travels whole.
    """
    # A single order column keeps the aggregate on the hash path.
    single = len(order) == 1
    position = F.col(order[0]) if single else F.struct(*order)
    firsts = rows.groupBy(*group, name).agg(F.min(position).alias("_at"))
    ranked = group_rank(firsts, group, ["_at", name], k, "slot")
    places = [F.col("_at").alias(order[0])] if single else [F.col(f"_at.{c}") for c in order]
    return ranked.select(*group, "slot", name, *places)


def complete(slots: DataFrame, group: Sequence[str], k: int = SLOTS) -> DataFrame:
    """Slots of the groups that fill all k places."""
    full = slots.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == k)
    return slots.join(full.select(*group), list(group), "left_semi")


def running_slot(
    rows: DataFrame, group: Sequence[str], name: str, order: Sequence[str],
    k: int = SLOTS, out: str = "slot",
) -> DataFrame:
    """Add the number of distinct names seen up to each row, capped at k.

    Rows of equal order are read in name order. Only the places where the first
    k names appear decide the count, so each row needs one array of at most k
    places per group and no window over the group.
    """
    firsts = first_k_distinct(rows, group, name, order, k)
    places = firsts.groupBy(*group).agg(
        F.collect_list(F.struct(*order, name)).alias("_places")  # at most k entries
    )
    here = F.struct(*order, name)
    return (
        rows.join(places, list(group), "left")
        .withColumn(out, F.size(F.filter("_places", lambda p: p <= here)))
        .drop("_places")
    )


def nested(rows: DataFrame, group: Sequence[str], entry: Sequence[str], out: str = "entries") -> DataFrame:
    """Rows nested into one document per group, in `entry` order.

    Choose a group that bounds its rows by nature (a batter's plays of one
    half-inning, the lines of one order): a document is one row of one task.
    """
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias(out))
