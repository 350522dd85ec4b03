from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorebook.operators import lookup, ordering


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_keep_first_and_last_follow_the_given_order(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("b", 2, "x"), ("a", 2, "w")], "k string, o int, v string")
    assert rows(lookup.keep_first(df, ["k"], ["o"]), "k", "o", "v") == [("a", 1, "y"), ("b", 2, "x")]
    assert rows(lookup.keep_last(df, ["k"], ["o"]), "k", "o", "v") == [("a", 3, "z"), ("b", 2, "x")]
    assert rows(lookup.duplicate_keys(df, ["k"]), "k", "n") == [("a", 3)]


def test_zero_and_mean_defaults(spark):
    left = spark.createDataFrame([("t", "a", 1), ("t", "x", 2)], "team string, name string, i int")
    right = spark.createDataFrame([("t", "a", 2, None), ("t", "b", 6, 5.0)], "team string, name string, hr int, era double")
    zero = lookup.with_zero_default(left, right, ["team", "name"], ["hr", "era"])
    assert rows(zero, "name", "hr", "era") == [("a", 2, 0.0), ("x", 0, 0.0)]
    mean = lookup.with_mean_default(left, right, ["team", "name"], ["hr", "era"])
    # A record with a missing figure is still a hit; only a missing record reads as means.
    assert rows(mean, "name", "hr", "era") == [("a", 2.0, None), ("x", 4.0, 5.0)]


def test_known_names_and_last_source(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "n string")
    names = spark.createDataFrame([("b",), ("b",), ("c",)], "n string")
    assert rows(lookup.known_names(left, names, ["n"]), "n") == [("b",), ("b",)]
    batters = spark.createDataFrame([("a", "T", 1), ("b", "G", 2), ("b", "S", 3)], "name string, team string, o int")
    pitchers = spark.createDataFrame([("a", "DB", 0)], "name string, team string, o int")
    assert rows(lookup.last_source_wins([batters, pitchers], "name", "team", "o"), "name", "team") == [("a", "DB"), ("b", "S")]


def test_id_dictionary_is_dense_and_in_code_point_order(spark):
    first = spark.createDataFrame([("岡林",), ("a",), ("B",), (None,)], "n string").repartition(3)
    second = spark.createDataFrame([("a",), ("ｚ",), ("z",)], "m string")
    ids = {r.name: r.id for r in lookup.id_dictionary(first, second).collect()}
    assert ids == {n: i for i, n in enumerate(sorted({"岡林", "a", "B", "ｚ", "z"}))}


def test_dense_index_over_many_partitions(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(7)
    got = {r.k: r.id for r in ordering.dense_index(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 5000
    assert ordering.dense_index(df.filter("k = ''"), ["k"]).count() == 0


def test_opponent_is_the_first_other_team(spark):
    df = spark.createDataFrame(
        [(1, "A", 0, "pa"), (1, "B", 1, "pb"), (2, "C", 0, "pc"), (3, "X", 0, "x"), (3, "Y", 1, "y"), (3, "Z", 2, "z")],
        "g int, t string, p int, s string",
    )
    got = lookup.with_opponent(df, "g", "t", "p", carry=["s"])
    assert rows(got, "g", "t", "opponent", "opponent_s") == [
        (1, "A", "B", "pb"), (1, "B", "A", "pa"), (3, "X", "Y", "y"), (3, "Y", "X", "x"), (3, "Z", "X", "x"),
    ]


def test_prefix_match_needs_a_single_candidate(spark):
    full = spark.createDataFrame([("T", "岡林勇希"), ("T", "岡本和真"), ("S", "岡本"), ("T", "山" * 40 + "一")], "t string, f string")
    short = spark.createDataFrame([("T", "岡林"), ("T", "岡"), ("S", "岡"), ("T", "東"), ("T", "山" * 40)], "t string, s string")
    got = lookup.unique_prefix_match(short, full, "t", "s", "f")
    assert rows(got, "t", "s", "f") == [("S", "岡", "岡本"), ("T", "山" * 40, "山" * 40 + "一"), ("T", "岡林", "岡林勇希")]


def test_league_row_by_mean_and_by_sum(spark):
    df = spark.createDataFrame([("T", "a", 1, 2), ("T", "b", 2, None)], "team string, name string, ab int, hr int")
    by_mean = lookup.append_league_row(df, {"team": "L", "name": "AVG"}).filter("team = 'L'").first()
    by_sum = lookup.append_league_row(df, {"team": "L", "name": "AVG"}, "sum").filter("team = 'L'").first()
    assert (by_mean.ab, by_mean.hr) == (1.5, 2.0) and (by_sum.ab, by_sum.hr) == (1.5, 1.0)
    with pytest.raises(ValueError):
        lookup.league_average(df, {}, "median")


@pytest.mark.parametrize("n,want", [(11, 3), (10, 2), (1, 1), (1000, 200)])
def test_holdout_takes_the_ceiling_of_the_fraction(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("game_id"), F.lit("t").alias("team"))
    split = ordering.with_holdout(df, ["game_id", "team"]).select("game_id", "is_valid").collect()
    import hashlib
    ordered = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}:t".encode()).hexdigest())
    assert {r.game_id for r in split if r.is_valid} == set(ordered[:want])


def test_holdout_of_nothing(spark):
    df = spark.range(0).withColumnRenamed("id", "game_id")
    assert ordering.with_holdout(df, ["game_id"]).count() == 0
    some = ordering.with_holdout(spark.range(5), ["id"], fraction=0.0)
    assert some.filter("is_valid").count() == 0


def test_holdout_keeps_rows_of_one_key_together(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    sides = ordering.with_holdout(df, ["k"]).groupBy("k").agg(F.countDistinct("is_valid").alias("n")).collect()
    assert {r.n for r in sides} == {1}


def test_a_second_record_of_a_key_is_an_error(spark):
    left = spark.createDataFrame([("a", 1)], "k string, i int")
    right = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    with pytest.raises(Exception, match="more than one row for a"):
        lookup.with_zero_default(left, right, ["k"], ["v"]).collect()


def test_keeping_one_row_needs_no_sort_aggregate(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "w")], "k string, o int, v string")
    for keep, want in ((lookup.keep_first, [("a", 1, "y"), ("b", None, "w")]), (lookup.keep_last, [("a", 2, "x"), ("b", None, "w")])):
        out = keep(df, ["k"], ["o"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan
        assert sorted(map(tuple, out.collect())) == want
