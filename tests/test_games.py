from __future__ import annotations

import pytest
from documents import game, lineup, nine, opening, play, write
from pyspark.sql import functions as F

from scorebook.operators import summary
from scorebook.sources import games, sinks


@pytest.fixture(scope="module")
def docs():
    a, b = nine("a"), nine("b")
    return {
        "cl2025050101": game("cl2025050101", ["中日", "ＤｅＮＡ"], ["０", "１０"], [
            opening([lineup("中日", a), lineup("ＤｅＮＡ", b)]),
            play("1回表", "1番 a1", "左安"), play("1回裏", "1番 b1", "三振"),
            play("2回表", "９番　a9", "四球"), play("2回表", "代打 a1", "左本"), play("3回表", "2番 a2"),
        ]),
        "il2025040101": game("il2025040101", ["巨人", "阪神"], ["5", "中止"], [
            opening([lineup("巨人", a), lineup("巨人", b), lineup("阪神", a[:8])],
                    [{"team": "阪神", "name": "p1"}, {"team": "阪神", "name": "p2"}, {"team": "巨人", "name": "p3"}]),
        ]),
        "pl2025030101": game("pl2025030101", ["西武", "楽天"], ["x", "2"], []),
    }


@pytest.fixture(scope="module")
def read(spark, docs, tmp_path_factory):
    return games.read_games(spark, write(tmp_path_factory.mktemp("games"), docs)).cache()


def test_scores_read_full_width_digits(read):
    got = {(r.game_id, r.team): r.runs for r in games.scores(read).collect()}
    assert got[("cl2025050101", "DeNA")] == 10 and got[("cl2025050101", "中日")] == 0
    assert got[("il2025040101", "阪神")] is None


def test_readable_scores_keep_the_prefix_of_a_game(read):
    got = sorted((r.game_id, r.pos, r.runs) for r in games.readable_scores(read).collect())
    assert got == [("cl2025050101", 0, 0), ("cl2025050101", 1, 10), ("il2025040101", 0, 5)]
    stats = summary.score_stats(games.readable_scores(read)).first()
    assert (stats.n, stats["mean"]) == (3, 5.0)


def test_plays_in_order_with_both_line_forms(read):
    rows = games.plays(read).filter("game_id = 'cl2025050101'").orderBy("entry_pos").collect()
    assert [(r.inning_no, r.is_top, r.slot, r.name, r.token, r.result) for r in rows] == [
        (1, True, 1, "a1", "a1", "左安"), (1, False, 1, "b1", "b1", "三振"), (2, True, 9, "a9", None, "四球"),
        (2, True, None, None, "a1", "左本"), (3, True, 2, "a2", "a2", None),
    ]
    assert games.appearances(read).count() == 3


def test_samples_last_entry_wins_and_short_line_ups_drop(read):
    rows = {(r.game_id, r.team): r for r in games.samples(read).collect()}
    assert set(rows) == {("cl2025050101", "中日"), ("cl2025050101", "DeNA"), ("il2025040101", "巨人")}
    giants = rows[("il2025040101", "巨人")]
    assert giants.players == nine("b") and giants.starter == "p2" and giants.opponent == "阪神"
    assert rows[("cl2025050101", "中日")].starter == "不明"
    assert games.samples(read, None).count() == 6


def test_views_of_documents_do_not_shuffle(read, spark):
    for view in (games.scores, games.plays, games.samples):
        assert "Exchange" not in view(read)._jdf.queryExecution().executedPlan().toString()


def test_names_of_line_ups_and_plays(read):
    assert {r.name for r in games.names(read).collect()} == {*nine("a"), *nine("b")}


def test_a_file_without_its_document_is_an_error_unless_tolerated(spark, docs, tmp_path):
    folder = write(tmp_path / "g", {**docs, "xx2025010101": '{"url": "x", "scoreboard": [{"team"'})
    with pytest.raises(Exception):
        games.read_games(spark, folder).select(F.size("scoreboard")).collect()
    assert games.read_games(spark, folder, tolerant=True).count() == 3


def test_documents_written_per_line_and_per_game(spark, read, tmp_path):
    sinks.write_games(read.drop("game_id"), str(tmp_path / "lines"))
    back = games.read_games(spark, str(tmp_path / "lines"), multi_line=False)
    assert {r.game_id for r in back.select("game_id").collect()} == {r.game_id for r in read.select("game_id").collect()}
    assert games.appearances(back).count() == 3
    sinks.write_games(read, str(tmp_path / "each"), per_game=True)
    assert (tmp_path / "each" / "game_id=cl2025050101").is_dir()


def test_has_plays(read):
    assert [r.game_id for r in games.has_plays(read).collect()] == ["cl2025050101"]
