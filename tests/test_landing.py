from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_season import initial, log, pitchers, read  # noqa: F401

from scorebook import season
from scorebook.functions.classify import MEASURES
from scorebook.operators import features
from scorebook.sources import games as docs
from scorebook.sources import landing


@pytest.fixture(scope="module")
def landed(read, tmp_path_factory):  # noqa: F811
    return landing.land(read, str(tmp_path_factory.mktemp("landed")), buckets=4)


@pytest.fixture(scope="module")
def batters(spark):
    rows = [(t, f"{p}{i}", 1, 0.3, float(i), 0.5, 0.7) for t, p in (("DeNA", "a"), ("阪神", "b")) for i in range(1, 9)]
    return spark.createDataFrame(rows, "team string, name string, hand int, avg double, hr double, slg double, ops double")


def rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))


def test_landed_views_equal_those_of_the_documents(landed, read):  # noqa: F811
    assert rows(landed.plays()) == rows(docs.plays(read))
    assert rows(landed.appearances()) == rows(docs.appearances(read))
    assert rows(landed.scores()) == rows(docs.scores(read))
    assert rows(landed.samples()) == rows(docs.samples(read)) and rows(landed.samples(3)) == []
    assert rows(landed.slots()) == rows(features.line_up_slots(docs.samples(read)))


def test_a_season_from_landed_tables_equals_one_from_documents(landed, read, initial, pitchers, batters):  # noqa: F811
    for make in (
        lambda g: season.season_samples(g, batters, pitchers, "A", ("hand", "era")),
        lambda g: season.running_samples(g, initial, pitchers, ("hand", "era")),
        season.count_appearances,
        season.appearance_report,
    ):
        assert rows(make(landed)) == rows(make(read))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_of_landed_tables_need_no_exchange(landed, batters, no_broadcast):
    landed.put("batters", batters, landing.BY_PLAYER, 4)
    figures = features.with_batters(landed.slots(), landed.table("batters"), features.batter_columns("A"))
    assert figures.count() == 8 * 2 * 9
    plan = plan_of(landed.slots().join(landed.table("batters"), ["team", "name"], "left"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    per_side = landed.table("samples").select("game_id", "team", "runs")
    assert "Exchange" not in plan_of(per_side.join(landed.table("samples").select("game_id", "team", "starter"), ["game_id", "team"]))
    per_game = landed.plays().groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    joined = plan_of(per_game.join(landed.scores(), "game_id"))
    assert "SortMergeJoin" in joined and "Exchange" not in joined


def test_another_session_opens_what_was_landed(spark, landed):
    other = spark.newSession()
    again = landing.opened(other, landed.path)
    assert rows(again.plays()) == rows(landed.plays()) and "slots" in again.names()
    with pytest.raises(FileNotFoundError):
        again.table("none")


def test_a_table_that_is_landed_again_is_replaced(spark, tmp_path):
    place = landing.Landed(spark, str(tmp_path / "l"))
    place.put("t", spark.range(5).withColumnRenamed("id", "game_id"), landing.BY_GAME, 2)
    place.put("t", spark.range(9).withColumnRenamed("id", "game_id"), landing.BY_GAME, 2)
    assert place.table("t").count() == 9 and place.names() == ["t"]
    assert MEASURES
