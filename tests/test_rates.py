from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorebook.functions import rates
from scorebook.operators import summary

COLS = "team string, name string, ab int, h int, tb int, bb int, hbp int, sf int, hr int, sb int, triples int"


def players(spark):
    return spark.createDataFrame(
        [
            ("T", "none", 0, 0, 0, 0, 0, 0, 0, 0, 0),
            ("T", "zero", 10, 0, 0, 0, 0, 0, 0, 0, 0),
            # Exactly on every threshold: 15 homers, .400, .290, 10 steals, 3 triples, no extra walks.
            ("G", "edge", 1000, 290, 400, 0, 0, 0, 15, 10, 3),
            ("G", "star", 100, 40, 60, 20, 0, 0, 16, 11, 0),
            ("C", "walk", 100, 20, 30, 30, 5, 5, 0, 0, 4),
        ],
        COLS,
    )


def test_guards_differ_for_players_without_at_bats(spark):
    kept = {r.name: r for r in rates.with_rates(players(spark), "max1").collect()}
    assert kept["none"].avg == 0.0 and kept["none"].ops == 0.0
    assert {r.name for r in rates.with_rates(players(spark), "filter").collect()} == {"zero", "edge", "star", "walk"}
    walk = kept["walk"]
    assert walk.obp == 55 / 140 and walk.isod == 55 / 140 - 0.2 and walk.ops == 55 / 140 + 0.3
    with pytest.raises(ValueError):
        rates.with_rates(players(spark), "other")


def test_flags_need_more_than_the_threshold(spark):
    typed = rates.with_types(rates.with_rates(players(spark)))
    got = {r.name: tuple(r[c] for c in rates.TYPE_COLUMNS) for r in typed.collect()}
    assert got["edge"] == (0, 0, 0, 0, 0) and got["none"] == (0, 0, 0, 0, 0)
    assert got["star"] == (1, 1, 1, 1, 1) and got["walk"] == (0, 0, 1, 1, 0)


def test_rosters_overlap_and_are_sorted(spark):
    typed = rates.with_types(rates.with_rates(players(spark)))
    got = [(r.type, r.team, r.name, r.members) for r in summary.rosters(typed).collect()]
    assert got == [
        ("type_all", "G", "star", 1), ("type_avg", "G", "star", 1), ("type_eye", "C", "walk", 2),
        ("type_eye", "G", "star", 2), ("type_power", "G", "star", 1), ("type_speed", "C", "walk", 2),
        ("type_speed", "G", "star", 2),
    ]


def test_pitch_groups_sum_the_columns_that_exist(spark):
    df = spark.createDataFrame([("a", 40.0, 10.0, None)], "name string, `pitch_ストレート_share` double, `pitch_フォーク_share` double, `pitch_カーブ_share` double")
    got = rates.with_pitch_groups(df).first()
    assert (got.fast_group, got.breaking_group, got.falling_group) == (40.0, 0.0, 10.0)
    assert rates.with_pitch_groups(spark.range(1)).first().fast_group == 0.0


def test_pivot_fills_missing_kinds(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0)], "n string, k string, s double")
    wide = summary.pivot_shares(long, ["n"], "k", "s", ["x", "y"])
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, 2.0), ("b", 0.0, 3.0)]


def test_relative_power_uses_a_default_era(spark):
    df = spark.createDataFrame([(0.3, 2.0), (0.3, None)], "a double, e double")
    got = [r[0] for r in df.select(rates.relative_power(F.col("a"), F.col("e"))).collect()]
    assert got == [0.3 - 0.2, 0.3 - 0.4]


def test_count_with_total(spark):
    df = spark.createDataFrame([("g1",), ("g1",), ("g2",), (None,)], "g string")
    assert sorted(((r.g, r.n) for r in summary.count_with_total(df, "g").collect()), key=str) == [
        ("TOTAL", 4), ("g1", 2), ("g2", 1), (None, 1),
    ]
