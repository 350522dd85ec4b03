from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_running import frames, make_log, replay

from scorebook.functions.classify import MEASURES
from scorebook.operators import corrections, running

PLAYS = "game_id string, visitor string, home string, is_top boolean, name string, result string"


def order():
    return running.order_key(F.col("game_id"))


def kept(spark, path, log):
    asked, plays, initial = frames(spark, log)
    store = corrections.PointInTime(spark, str(path), ["team", "name"], "_order", MEASURES, 6, "game_id")
    store.build(asked.withColumn("_order", order()), running.changes(plays), initial)
    return store


def got(store):
    return {(r.game_id, r.team, r.name): tuple(r[m] for m in MEASURES) for r in store.totals().collect()}


def overwrite(spark, store, games, plays):
    store.correct(
        spark.createDataFrame([(g,) for g in games], "game_id string").select(order().alias("_order")),
        running.changes(spark.createDataFrame(plays, PLAYS)),
    )


@pytest.mark.parametrize("seed", [2, 8])
def test_corrections_equal_a_full_recomputation(spark, tmp_path, seed):
    plays, asked, initial = make_log(seed)
    store = kept(spark, tmp_path, (plays, asked, initial))
    assert got(store) == replay(plays, asked, initial, "batting", "date")
    rng, other = random.Random(seed), make_log(seed + 50)[0]
    games = sorted({p[0] for p in plays}, key=lambda g: g[2:10])
    for some in ([games[4]], [games[0], games[-1]]):
        new = [(rng.choice(some), *p[1:]) for p in rng.sample(other, 25)] + [(some[0], "V", "H", True, "newcomer", "左本")]
        plays = [p for p in plays if p[0] not in some] + new
        overwrite(spark, store, some, new)
        assert got(store) == replay(plays, asked, initial, "batting", "date")
    overwrite(spark, store, [games[2]], [])  # the game is emptied
    plays = [p for p in plays if p[0] != games[2]]
    assert got(store) == replay(plays, asked, initial, "batting", "date")


def test_only_touched_chunks_are_read_and_rewritten(spark, tmp_path):
    plays, asked, initial = make_log(4)
    store = kept(spark, tmp_path, (plays, asked, initial))
    games = sorted({p[0] for p in plays}, key=lambda g: g[2:10])
    one = games[len(games) // 2]
    chunk = f"c_{one[2:8]}"
    before = store.steps.manifest().parts, store.offsets.manifest().parts
    ref = spark.createDataFrame([(one,)], "game_id string").select(order().alias("_order"))
    steps, _ = store.corrected_steps(ref, running.changes(spark.createDataFrame([(one, "V", "H", True, "hot", "左本")], PLAYS)))
    assert {f.split("_part=")[1].split("/")[0] for f in steps.inputFiles() if "/steps/" in f} == {chunk}
    overwrite(spark, store, [one], [(one, "V", "H", True, "hot", "左本")])
    after = store.steps.manifest().parts, store.offsets.manifest().parts
    assert {p for p in after[0] if after[0][p] != before[0].get(p)} == {chunk}
    assert all(p >= chunk for p in after[1] if after[1][p] != before[1].get(p))


def test_a_reader_between_the_two_switches_sees_the_old_pair(spark, tmp_path, monkeypatch):
    plays, asked, initial = make_log(6)
    store = kept(spark, tmp_path, (plays, asked, initial))
    want = got(store)
    with monkeypatch.context() as m:
        m.setattr(corrections.PointInTime, "_before", lambda self, rows: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            overwrite(spark, store, [plays[0][0]], [])
    assert got(store) == want
    overwrite(spark, store, [plays[0][0]], [])  # the same correction again, after the crash
    rest = [p for p in plays if p[0] != plays[0][0]]
    assert got(store) == replay(rest, asked, initial, "batting", "date")


def test_nothing_to_correct(spark, tmp_path):
    log = make_log(3)
    store = kept(spark, tmp_path, log)
    version = store.steps.manifest().version
    overwrite(spark, store, [], [])
    assert store.steps.manifest().version == version
