from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook import session
from scorebook.operators import features, scaling, summary
from scorebook.plans import views


@pytest.fixture(scope="module")
def parts(spark):
    samples = spark.createDataFrame(
        [("g1", "A", 3, "B", "p1", ["a", "b", "x"]), ("g1", "B", 1, "A", "??", ["c", "c2", "a"])],
        "game_id string, team string, runs int, opponent string, starter string, players array<string>",
    )
    batters = spark.createDataFrame(
        [("A", "a", "左打", 0.3, 5), ("A", "b", "両打", 0.2, 1), ("B", "c", None, 0.1, 0)],
        "team string, name string, hand string, avg double, hr int",
    )
    pitchers = spark.createDataFrame(
        [("B", "p1", "左投", 2.0, 1), ("B", "p1", "右投", 9.0, 2), ("A", "p2", "右投", 4.0, 3)],
        "team string, name string, hand string, era double, line int",
    )
    slots = features.with_batters(features.line_up_slots(samples), features.prepare_batters(batters), ["hand", "avg", "hr"])
    table = features.prepare_pitchers(pitchers, ["line"])
    teams = features.with_pitchers(samples.drop("players"), table, ["hand", "era"])
    return slots, teams


def test_flat_vectors(parts):
    slots, teams = parts
    got = {r.team: (r.runs, r.vec) for r in features.flat(slots, teams, ["hand", "avg", "hr"], ["hand", "era"], 3).collect()}
    # p1 is read from its first line; the unknown starter reads as the means over p1 and p2.
    assert got == {
        "A": (3, [1, 0.3, 5, 2, 0.2, 1, 0, 0, 0, 1, 2.0]),
        "B": (1, [0, 0.1, 0, 0, 0, 0, 0, 0, 0, 0.5, 3.0]),
    }


def test_sequences_repeat_the_pitcher(parts):
    slots, teams = parts
    got = {r.team: r.seq for r in features.sequence(slots, teams, ["avg"], ["era"], 3).collect()}
    assert got["A"] == [[0.3, 2.0], [0.2, 2.0], [0.0, 2.0]]


def test_incomplete_line_ups_give_no_vector(parts):
    slots, teams = parts
    short = slots.filter("not (team = 'B' and slot = 2)")
    assert [r.team for r in features.flat(short, teams, ["avg"], [], 3).collect()] == ["A"]


@pytest.mark.parametrize("pattern,pitchers,width", [("rates", 0, 36), ("full", 24, 69), ("A", 7, 43), ("B", 7, 61)])
def test_widths(pattern, pitchers, width):
    names = features.flat_names(features.batter_columns(pattern), [f"p{i}" for i in range(pitchers)])
    assert len(names) == width


def test_feature_columns_follow_the_table(spark):
    df = spark.createDataFrame([("a", "b", 1, 2)], "team string, name string, x int, y int")
    assert features.feature_columns(df) == ["x", "y"]


def test_column_scaling_with_a_constant_column(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(5)], "x double, c double")
    got = np.array([[r.x, r.c] for r in scaling.standardized(df, ["x", "c"]).orderBy("x").collect()])
    x = np.arange(5.0)
    np.testing.assert_allclose(got[:, 0], (x - x.mean()) / x.std())
    assert (got[:, 1] == 0).all()


def test_scaling_may_be_fitted_elsewhere(spark):
    train = spark.createDataFrame([([0.0, 1.0],), ([2.0, 1.0],)], "vec array<double>")
    valid = spark.createDataFrame([([4.0, 5.0],)], "vec array<double>")
    assert scaling.standardized_vector(valid, "vec", 2, train).first().vec == [3.0, 4.0]


def test_pooled_scaling(spark):
    seq = np.random.default_rng(0).normal(size=(4, 9, 2))
    df = spark.createDataFrame([(i, seq[i].tolist()) for i in range(4)], "i int, seq array<array<double>>")
    got = np.array([r.seq for r in scaling.standardized_sequence(df, "seq", 2).orderBy("i").collect()])
    flat = seq.reshape(-1, 2)
    np.testing.assert_allclose(got, (seq - flat.mean(0)) / flat.std(0))


def test_mean_baseline_truncates_like_an_integer_array(spark):
    train = spark.createDataFrame([(2,), (3,), (3,)], "runs int")
    valid = spark.createDataFrame([(2,), (4,)], "runs int")
    cut = scaling.mean_baseline(train, valid, "runs", True)
    assert {r.prediction for r in cut.collect()} == {2.0}
    assert summary.mse(cut, "runs", "prediction").first().mse == 2.0
    whole = scaling.mean_baseline(train, valid, "runs", False)
    assert {round(r.prediction, 6) for r in whole.collect()} == {round(8 / 3, 6)}


def test_scaling_uses_scalar_subqueries_not_joins(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"))
    plan = scaling.standardized(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_line_ups_are_widened_after_their_rows_have_met(spark):
    rows = [(g, t, s, float(s)) for g, t, n in [(1, "A", 3), (1, None, 3), (None, "B", 3), (2, "A", 2)] for s in range(1, n + 1)]
    rows += [(3, "A", 1, 1.0), (3, "A", 1, 4.0), (3, "A", 2, None), (4, "A", None, 1.0), (4, "A", 2, 5.0), (4, "A", 3, 6.0)]
    slots = spark.createDataFrame(rows, "game_id long, team string, slot int, x double")
    wide = features._wide(slots, ["x"], 3)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    got = {(r.game_id, r.team): (r._1_x, r._2_x, r._3_x) for r in wide.collect()}
    assert got == {
        (1, "A"): (1, 2, 3), (1, None): (1, 2, 3), (None, "B"): (1, 2, 3), (3, "A"): (4, None, None), (4, "A"): (None, 5, 6),
    }


def test_large_tables_are_dealt_to_more_tasks_with_the_same_samples(spark, parts, monkeypatch):
    slots, teams = parts
    args = (["hand", "avg", "hr"], ["hand", "era"], 3)
    plain = {make: make(slots, teams, *args) for make in (features.flat, features.sequence)}
    monkeypatch.setattr(session, "ROWS_A_TASK", 1)
    for make, want in plain.items():
        found = make(slots, teams, *args, rows=11)
        assert ", 11), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.dealt(slots, few, "name") is slots  # Spark's own number is enough


def test_line_ups_of_the_queries_follow_the_number_of_lines(spark, monkeypatch):
    place = "/root/testdata/sf0.001"
    want = {p: sorted(map(repr, views.flat_samples(spark, place, p).collect())) for p in "AB"}
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    tasks = -(-views.line_count(spark, place) // 500)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for p in "AB":
        found = views.flat_samples(spark, place, p)
        assert f", {tasks}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, found.collect())) == want[p]


def test_season_tables_of_the_samples_follow_the_number_of_lines(spark, monkeypatch):
    place = "/root/testdata/sf0.001"
    makes = views.typed_batters, views.coded_pitchers
    want = [sorted(map(repr, make(spark, place).collect())) for make in makes]
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    rows = views.line_count(spark, place)
    for make, same in zip(makes, want):
        found = make(spark, place, rows)
        assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, found.collect())) == same


def test_slots_meet_stored_batters(spark, tmp_path):
    line = (1, 1, 1, 1, 5.0, 1.0, 0.0, 0.0, "R", "F", None)
    lines = [(o, p, 1, i, *line[4:]) for o, ps in [(1, [7, 8, 9]), (2, [9, 9, 7])] for i, p in enumerate(ps, 1)]
    spark.createDataFrame(lines, views.SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = [(p, "n", "Brand#1", "SMALL", p, 1.0) for p in (7, 8, 9)]
    spark.createDataFrame(made, views.SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    slots = views.feature_slots(spark, str(tmp_path), "A", views.sides(spark, str(tmp_path)))
    plan = slots._jdf.queryExecution().optimizedPlan().toString()
    assert "p_brand" not in plan and plan.count("Aggregate") == 1  # the sides' own; the batters are counted already
    assert {(r.game_id, r.slot, r.name, r.hr) for r in slots.collect()} == {(1, 1, 7, 0), (1, 2, 8, 0), (1, 3, 9, 0)}
