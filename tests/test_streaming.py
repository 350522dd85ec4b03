from __future__ import annotations

from documents import game, lineup, nine, opening, play, write
from pyspark.sql import functions as F

from scorebook.functions.classify import MEASURES, deltas
from scorebook.sources import games
from scorebook.streaming import ingest


def doc(game_id, *plays):
    return game(game_id, ["A", "B"], ["1", "2"], [opening([lineup("A", nine("a"))]), *plays])


def test_only_new_files_are_taken_in_and_later_versions_win(spark, tmp_path):
    inbox, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")

    def run():
        ingest.ingest(ingest.game_stream(spark, str(inbox)), store, check).awaitTermination()
        return ingest.latest(spark, store, ["game_id"])

    write(inbox, {"cl1": doc("cl1"), "cl2": doc("cl2", play("1回表", "1番 a1", "左安"))})
    assert run().count() == 2
    write(inbox, {"cl3": doc("cl3", play("1回表", "1番 a1", "三振")), "cl1-again": doc("cl1", play("2回裏", "2番 b2", "四球"))})
    stored = run()
    assert {r.game_id for r in stored.collect()} == {"cl1", "cl2", "cl3"}
    assert {(r.game_id, r.result) for r in games.appearances(stored).collect()} == {("cl1", "四球"), ("cl2", "左安"), ("cl3", "三振")}
    batches = {r.batch_id: r.n for r in spark.read.parquet(store).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert batches == {0: 2, 1: 2}


def test_running_totals_grow_with_new_games(spark, tmp_path):
    inbox, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")

    def run():
        played = games.appearances(ingest.game_stream(spark, str(inbox)))
        changes = played.select("name", deltas(F.col("result"), "notation").alias("d")).select(
            "name", *[F.col(f"d.{m}").alias(m) for m in MEASURES]
        )
        ingest.store_totals(ingest.running_totals(changes, ["name"], MEASURES), store, check).awaitTermination()
        return {r.name: (r.ab, r.h, r.bb) for r in ingest.latest(spark, store, ["name"]).collect()}

    write(inbox, {"cl1": doc("cl1", play("1回表", "1番 a1", "左安"), play("2回表", "1番 a1", "三振"))})
    assert run() == {"a1": (2, 1, 0)}
    write(inbox, {"cl2": doc("cl2", play("1回表", "1番 a1", "四球"), play("2回表", "2番 a2", "左２"))})
    assert run() == {"a1": (2, 1, 1), "a2": (1, 1, 0)}
