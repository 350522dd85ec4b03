from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scorebook.functions.classify import MEASURES, RULES
from scorebook.operators import running

TEAMS = ("V", "H")
TEXTS = ["左安", "二ゴ", "三振", "四球", "死球", "左本", "中飛", "左２"]


def make_log(seed):
    """Plays in which one player owns about a third of the rows."""
    rng = random.Random(seed)
    games = [f"{rng.choice(['cl', 'il', 'pl'])}2025{m:02d}{d:02d}0{i}" for i, (m, d) in enumerate(
        sorted((rng.randint(3, 10), rng.randint(1, 28)) for _ in range(9)))]
    plays, asked = [], []
    for g in games:
        for _ in range(rng.randint(5, 30)):
            name = "hot" if rng.random() < 0.33 else f"n{rng.randint(0, 6)}"
            plays.append((g, "V", "H", rng.random() < 0.5, name, rng.choice(TEXTS)))
        asked += [(g, t, f"n{i}") for t in TEAMS for i in range(8)] + [(g, t, "hot") for t in TEAMS]
    rng.shuffle(plays)
    initial = [("V", "hot", 5, 2, 3, 0, 1, 0, 0), ("H", "n7", 9, 1, 1, 0, 0, 0, 0), ("V", "idle", 1, 1, 1, 0, 0, 0, 0)]
    return plays, asked, initial


def change(result):
    for rule in RULES["literal"]:
        if any(m in result for m in rule.markers):
            return [getattr(rule, m) for m in MEASURES]
    return [0] * len(MEASURES)


def replay(plays, asked, initial, credit, order_by):
    state = defaultdict(lambda: [0] * len(MEASURES), {(t, n): list(v) for t, n, *v in initial})
    key = (lambda g: g) if order_by == "file" else (lambda g: (g[2:10], g))
    out = {}
    for g in sorted({a[0] for a in asked}, key=key):
        for gid, t, n in asked:
            if gid == g:
                out[(g, t, n)] = tuple(state[(t, n)])
        for gid, v, h, top, n, result in plays:
            if gid == g:
                credited = {"both": (v, h), "last": (h,), "batting": (v if top else h,)}[credit]
                for t in credited:
                    state[(t, n)] = [a + b for a, b in zip(state[(t, n)], change(result))]
    return out


def frames(spark, log):
    plays, asked, initial = log
    return (
        spark.createDataFrame(asked, "game_id string, team string, name string"),
        spark.createDataFrame(plays, "game_id string, visitor string, home string, is_top boolean, name string, result string"),
        spark.createDataFrame(initial, "team string, name string, " + ", ".join(f"{m} int" for m in MEASURES)),
    )


def collected(df):
    return {(r.game_id, r.team, r.name): tuple(r[m] for m in MEASURES) for r in df.collect()}


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("credit", ["both", "last", "batting"])
def test_equals_a_sequential_replay(spark, seed, credit):
    log = make_log(seed)
    order_by = "date" if seed % 2 else "file"
    got = running.running_stats(*frames(spark, log), credit=credit, order_by=order_by, chunk_chars=[0, 4, 6, 8, 20][seed])
    assert collected(got) == replay(*log, credit, order_by)


def test_features_never_see_their_own_game(spark):
    plays, asked, initial = make_log(7)
    last = max(asked, key=lambda a: (a[0][2:10], a[0]))[0]
    before = collected(running.running_stats(*frames(spark, (plays, asked, initial))))
    changed = [p[:5] + ("左本",) if p[0] == last else p for p in plays]
    assert collected(running.running_stats(*frames(spark, (changed, asked, initial)))) == before


def test_a_busy_key_is_spread_over_chunks(spark):
    """Window groups hold one chunk of one key, not the whole history of the key."""
    plays, asked, _ = make_log(1)
    plan = running.running_stats(*frames(spark, (plays, asked, []))[:2])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(team" in plan and "_chunk" in plan.split("windowspecdefinition(team")[1]


def test_fractional_starting_totals_are_kept(spark):
    plays, asked, _ = make_log(2)
    initial = [("V", "hot", 10.5, 2.25, 3.0, 0.0, 1.0, 0.0, 0.0)]
    requests, played, _ = frames(spark, (plays, asked, []))
    start = spark.createDataFrame(initial, "team string, name string, " + ", ".join(f"{m} double" for m in MEASURES))
    got = collected(running.running_stats(requests, played, start))
    assert got == replay(plays, asked, initial, "batting", "date")


def test_unknown_modes_are_errors(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        running.credited(df, "nobody")
    with pytest.raises(ValueError):
        running.order_key(F.col("id"), "random")


def test_ids_with_dashes_come_back_whole(spark):
    games = ["cl2025032802-1t-u1", "cl2025032802-1t-u2", "cl2025032901-x"]
    plays = spark.createDataFrame(
        [(g, "A", "B", True, "u", "左安") for g in games], "game_id string, visitor string, home string, is_top boolean, name string, result string"
    )
    asked = spark.createDataFrame([(g, t, "u") for g in games for t in "AB"], "game_id string, team string, name string")
    for order_by in ("date", "file"):
        for credit in ("batting", "both", "last"):
            got = running.running_stats(asked, plays, credit=credit, order_by=order_by).collect()
            assert sorted({r.game_id for r in got}) == games
            side = "B" if credit == "last" else "A"
            assert [r.h for r in sorted(got) if r.team == side] == [0, 1, 2]


def test_starting_totals_may_lack_columns_but_not_repeat(spark):
    plays = spark.createDataFrame([("cl2025032801", "A", "B", True, "u", "左安")], "game_id string, visitor string, home string, is_top boolean, name string, result string")
    asked = spark.createDataFrame([("cl2025032901", "A", "u")], "game_id string, team string, name string")
    start = spark.createDataFrame([("A", "u", 5)], "team string, name string, ab int")
    got = running.running_stats(asked, plays, start).first()
    assert (got.ab, got.h, got.bb) == (6, 1, 0)
    with pytest.raises(Exception, match="more than one row for A u"):
        running.running_stats(asked, plays, start.union(start)).collect()
