from __future__ import annotations

import random

from pyspark.sql import functions as F

from scorebook.operators import lineups
from scorebook.plans import views
from scorebook.sources import games


def box(seed=0):
    """Two groups; one of them holds nearly all rows."""
    rng = random.Random(seed)
    rows = [("hot", i, f"n{rng.randint(0, 25)}") for i in range(400)]
    return rows + [("cold", i, f"m{rng.randint(0, 5)}") for i in range(12)]


def replay(rows, k):
    firsts, slots = {}, {}
    for g in {r[0] for r in rows}:
        seen = []
        for _, pos, name in sorted(r for r in rows if r[0] == g):
            if len(seen) < k and name not in seen:
                seen.append(name)
            slots[(g, pos)] = len(seen)
        firsts[g] = seen
    return firsts, slots


def test_first_k_distinct_and_running_slot_equal_a_row_by_row_reading(spark):
    rows = box()
    df = spark.createDataFrame(rows, "g string, pos int, name string").repartition(5)
    firsts, slots = replay(rows, 9)
    got = lineups.first_k_distinct(df, ["g"], "name", ["pos"], 9).orderBy("g", "slot").collect()
    assert {g: [r.name for r in got if r.g == g] for g in firsts} == firsts
    ran = lineups.running_slot(df, ["g"], "name", ["pos"], 9)
    assert {(r.g, r.pos): r.slot for r in ran.collect()} == slots


def test_map_tasks_cut_groups_before_the_shuffle(spark):
    df = spark.createDataFrame(box(), "g string, pos int, name string")
    plan = lineups.first_k_distinct(df, ["g"], "name", ["pos"], 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_complete_groups_only(spark):
    df = spark.createDataFrame(box(), "g string, pos int, name string")
    slots = lineups.first_k_distinct(df, ["g"], "name", ["pos"], 9)
    assert {r.g for r in lineups.complete(slots, ["g"], 9).collect()} == {"hot"}


def test_nesting_keeps_every_row_in_order(spark):
    df = spark.createDataFrame(box(), "g string, pos int, name string")
    docs = {n: lineups.nested(df.repartition(n), ["g"], ["pos", "name"]).collect() for n in (2, 5)}
    assert sorted(docs[2]) == sorted(docs[5])
    assert sorted((r.g, e.pos, e.name) for r in docs[2] for e in r.entries) == sorted(box())
    assert all([e.pos for e in r.entries] == sorted(e.pos for e in r.entries) for r in docs[2])


def test_a_game_of_very_many_plays_keeps_its_teams(spark, tmp_path):
    n = 50_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 97).alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props"),
    )
    stored = []
    for parts in (2, 5):
        events.repartition(parts).write.parquet(str(tmp_path / f"{parts}/events.parquet"))
        docs = views.documents(spark, str(tmp_path / str(parts)))
        assert docs.select("url").distinct().count() == docs.count()
        plays = games.plays(docs)
        assert plays.count() == n and plays.filter("visitor is null or home is null").count() == 0
        stored.append(sorted(docs.select("url", F.to_json("text_live").alias("live")).collect()))
    assert stored[0] == stored[1]
