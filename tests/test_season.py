from __future__ import annotations

import random
from collections import defaultdict

import pytest
from documents import game, lineup, nine, opening, play, write
from pyspark.sql import functions as F

from scorebook import season
from scorebook.functions.classify import MEASURES, RULES
from scorebook.operators import features
from scorebook.sources import games as docs

TEXTS = ["左安", "二ゴ", "三振", "四球", "死球", "左本", "遊ゴ"]


@pytest.fixture(scope="module")
def log():
    rng = random.Random(11)
    out = {}
    for i in range(8):
        game_id = f"{rng.choice(['cl', 'pl'])}2025{rng.randint(3, 9):02d}{rng.randint(1, 28):02d}0{i}"
        plays = [
            play(f"{rng.randint(1, 9)}回{half}", f"{n}番 {p}{n}", rng.choice(TEXTS))
            for half, p in (("表", "a"), ("裏", "b")) for n in range(1, 10) for _ in range(rng.randint(1, 4))
        ]
        pitchers = [{"team": "阪神", "name": f"p{i % 2}"}, {"team": "ＤｅＮＡ", "name": "none"}]
        lineups = [lineup("ＤｅＮＡ", nine("a")), lineup("阪神", nine("b"))]
        out[game_id] = game(game_id, ["ＤｅＮＡ", "阪神"], [str(i), "３"], [opening(lineups, pitchers), *plays])
    return out


@pytest.fixture(scope="module")
def read(spark, log, tmp_path_factory):
    return docs.read_games(spark, write(tmp_path_factory.mktemp("season"), log)).cache()


@pytest.fixture(scope="module")
def initial(spark):
    rows = [("DeNA", "a1", 1, *([10, 3, 5, 1, 2, 0, 1]))]
    return spark.createDataFrame(rows, "team string, name string, hand int, " + ", ".join(f"{m} int" for m in MEASURES))


@pytest.fixture(scope="module")
def pitchers(spark):
    return spark.createDataFrame([("阪神", "p0", 1, 2.0), ("阪神", "p1", 0, 4.0)], "team string, name string, hand int, era double")


def replayed(log):
    """Running figures read and updated game by game, both teams credited."""
    state = defaultdict(lambda: dict.fromkeys(MEASURES, 0))
    state[("DeNA", "a1")] = dict(zip(MEASURES, [10, 3, 5, 1, 2, 0, 1]))
    out = {}
    for game_id in sorted(log):
        doc = log[game_id]
        for team, players in (("DeNA", nine("a")), ("阪神", nine("b"))):
            seq = []
            for p in players:
                s = state[(team, p)]
                ab = max(s["ab"], 1)
                obp = (s["h"] + s["bb"] + s["hbp"]) / max(s["ab"] + s["bb"] + s["hbp"] + s["sf"], 1)
                seq.append([s["h"] / ab, s["hr"], s["tb"] / ab, obp + s["tb"] / ab])
            out[(game_id, team)] = seq
        for entry in doc["text_live"][1:]:
            line, result = entry["plays"][0]["lines"]
            rule = next((r for r in RULES["literal"] if any(m in result for m in r.markers)), None)
            for team in ("DeNA", "阪神"):
                for m in MEASURES:
                    state[(team, line.split(" ")[1])][m] += getattr(rule, m) if rule else 0
    return out


def test_running_sequences(log, read, initial):
    got = season.running_samples(read, initial)
    assert {(r.game_id, r.team): r.seq for r in got.collect()} == replayed(log)
    assert {r.runs for r in got.filter("team = '阪神'").collect()} == {3}


def test_running_sequences_with_hand_and_pitcher(log, read, initial, pitchers):
    got = {(r.game_id, r.team): r.seq for r in season.running_samples(read, initial, pitchers, ["hand", "era"]).collect()}
    for (game_id, team), seq in replayed(log).items():
        p = log[game_id]["text_live"][0]["pregame"]["pitchers"][0]["name"]
        tail = {"p0": [1, 2.0], "p1": [0, 4.0]}[p] if team == "DeNA" else [0.5, 3.0]
        want = [[1 if team == "DeNA" and i == 0 else 0, *step, *tail] for i, step in enumerate(seq)]
        assert got[(game_id, team)] == want


def test_flat_running_vectors_have_36_places(read, initial):
    assert features.shape(season.running_samples(read, initial, layout="flat")).first() == (16, 36)


def test_season_samples(read, initial, pitchers, log):
    batters = initial.selectExpr("team", "name", "hand", "0.3D as avg", "hr", "0.5D as slg")
    got = season.season_samples(read, batters, pitchers, "A", ["hand", "era"])
    rows = {(r.game_id, r.team): r.vec for r in got.collect()}
    assert len(rows) == 16 and {len(v) for v in rows.values()} == {38}
    some = next(k for k in rows if k[1] == "DeNA")
    assert rows[some][:5] == [1, 0.3, 1, 0.5, 0]
    powered = season.season_samples(read, batters, pitchers, "A", ["era"], with_power=True)
    for r in powered.filter("team = 'DeNA'").collect():
        assert len(r.vec) == 46 and r.vec[4] == 0.3 - r.vec[-1] / 10 and r.vec[9] == 0.0 - r.vec[-1] / 10
    assert {r.vec[4] for r in powered.filter("team = '阪神'").collect()} == {0.0 - 4.0 / 10}
    with pytest.raises(ValueError):
        season.season_samples(read, batters, pitchers, "A", ["era"], layout="cube")


def test_appearances_and_report(log, read):
    counts = {r.game_id: r.n for r in season.count_appearances(read).collect()}
    assert counts.pop("TOTAL") == sum(counts.values()) and counts == {g: len(d["text_live"]) - 1 for g, d in log.items()}
    lines = [r.line for r in season.appearance_report(read).orderBy("line_no", "game_id").collect()]
    assert lines[0] == f"{min(log)}.json: {counts[min(log)]}打席"
    assert lines[-3:] == ["-" * 40, "対象ファイル数: 8", f"総打席数: {sum(counts.values())}"]


def test_classified_batters(spark):
    cols = "team string, name string, hand string, ab int, h int, triples int, hr int, tb int, sb int, bb int, hbp int, sf int"
    df = spark.createDataFrame([("T", "a", "右打", 100, 40, 4, 0, 50, 0, 30, 0, 0), ("T", "b", "右打", 0, *[0] * 8)], cols)
    row = season.classified_batters(df).collect()
    assert len(row) == 1 and row[0].type_all == 1 and row[0].type_power == 1 and len(row[0]) == 13


def test_affinity_listing_uses_the_last_team_and_codes(spark):
    hitters = spark.createDataFrame([("h1", "巨人", 0), ("h2", "ＤｅＮＡ", 1), ("both", "巨人", 2)], "name string, team string, line int")
    pitchers = spark.createDataFrame([("p1", "G", 0), ("p2", "DB", 1), ("both", "T", 2), ("new", "T", 3)], "name string, team string, line int")
    ids = spark.createDataFrame([(n, i) for i, n in enumerate(["both", "h1", "h2", "p1", "p2"])], "name string, id int")
    factors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id int, v array<double>")
    got = {(r.hitter, r.pitcher, r.rank) for r in season.affinity_listing(hitters, pitchers, ids, factors, 10).collect()}
    assert got == {
        ("h1", "p2", 1), ("h1", "both", 2), ("h2", "p1", 1), ("h2", "both", 2), ("both", "p1", 1), ("both", "p2", 2),
    }


def test_names_of_the_weight_ranking():
    names = features.flat_names(features.batter_columns("B"), features.PITCHER_GROUPED)
    assert names[:6] == ["1番_Hand", "1番_Power", "1番_Average", "1番_Speed", "1番_Eye", "1番_All-Rounder"]
    assert names[-7:] == ["P_hand", "P_ERA", "P_K/9", "P_HR/9", "P_Fast_G", "P_Break_G", "P_Fall_G"]
