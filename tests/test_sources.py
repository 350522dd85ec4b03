from __future__ import annotations

import pytest
from documents import game, lineup, nine, opening, play, write
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook import session
from scorebook.operators import lookup
from scorebook.sources import games, sinks, tables, urls

BATTERS = "﻿team,name,Hand,AB,H,2B,3B,HR,TB,SB,BB,HBP,SF\n巨人,岡本,右打,500,140,30,1,27,253,1,60,5,4\nLG,AVG,右打,10.5,,0,0,0,0,0,0,0,0\n"
LATER = "﻿team,name,AB,H\nＤｅＮＡ,牧,400,120\n"


def test_season_table_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_text(BATTERS, encoding="utf-8")
    rows = tables.read_table(spark, str(tmp_path / "b.csv")).collect()
    assert rows[0].asDict() == {
        "team": "巨人", "name": "岡本", "hand": "右打", "ab": 500.0, "h": 140.0, "doubles": 30.0, "triples": 1.0,
        "hr": 27.0, "tb": 253.0, "sb": 1.0, "bb": 60.0, "hbp": 5.0, "sf": 4.0,
    }
    assert rows[1].ab == 10.5 and rows[1].h is None


def test_seasons_with_different_columns(spark, tmp_path):
    for name, text in (("a", BATTERS), ("b", LATER)):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    both = tables.seasons(*[tables.read_table(spark, str(tmp_path / f"{n}.csv")) for n in "ab"])
    row = both.filter("name = '牧'").first()
    assert row.ab == 400.0 and row.hand is None and row.sb is None


def test_typed_read_checks_the_header(spark, tmp_path):
    (tmp_path / "b.csv").write_text("name,ab\nx,3\n", encoding="utf-8")
    good = T.StructType([T.StructField("name", T.StringType()), T.StructField("ab", T.IntegerType())])
    assert tables.read_typed(spark, str(tmp_path / "b.csv"), good).first().ab == 3
    wrong = T.StructType([T.StructField("ab", T.StringType()), T.StructField("name", T.StringType())])
    with pytest.raises(Exception):
        tables.read_typed(spark, str(tmp_path / "b.csv"), wrong).collect()


def test_dash_era_becomes_the_sentinel(spark):
    df = spark.createDataFrame([("-",), ("3.1",)], "era string")
    assert [r.era for r in tables.clean_pitcher_counts(df).collect()] == ["9.99", "3.1"]


def test_missing_inputs_are_reported(spark, tmp_path):
    (tmp_path / "here.txt").write_text("x")
    found, missing = tables.existing(spark, [str(tmp_path / "here.txt"), str(tmp_path / "gone.txt")])
    assert (len(found), len(missing)) == (1, 1) and missing[0].endswith("gone.txt")


def test_table_written_as_one_file(spark, tmp_path):
    tables.write_table(spark.range(10).repartition(4), str(tmp_path / "t"), single_file=True)
    assert len(list((tmp_path / "t").glob("*.csv"))) == 1


def test_dictionary_and_its_inverse(spark, tmp_path):
    ids = lookup.id_dictionary(spark.createDataFrame([("b",), ("a",)], "n string"))
    sinks.write_dictionary(ids, str(tmp_path / "ids"))
    assert sorted(map(tuple, sinks.read_dictionary(spark, str(tmp_path / "ids")).collect())) == [("a", 0), ("b", 1)]
    sinks.write_dictionary(ids, str(tmp_path / "json"), fmt="json")
    assert sinks.read_dictionary(spark, str(tmp_path / "json"), fmt="json").count() == 2
    inverted = sinks.read_dictionary(spark, str(tmp_path / "ids"), inverted=True)
    assert inverted.columns == ["id", "name"] and inverted.filter("id = 1").first().name == "b"


def test_report_keeps_its_order(spark, tmp_path):
    lines = spark.range(100).select("id", F.format_string("%03d", "id").alias("line")).repartition(5)
    sinks.write_report(lines, str(tmp_path / "r"), ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split() == [f"{i:03d}" for i in range(100)]


def test_urls_from_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a /score/cl1.html b /score/pl2.html\nnothing\n/score/cl1.html /score/xx3.html /score/il04.html\n")
    found = urls.extract_urls(spark.read.text(str(tmp_path / "s.txt")), "value", r"/score/" + urls.GAME_PAGE, "https://s.example")
    assert [r.url for r in found.collect()] == [f"https://s.example/score/{g}.html" for g in ("cl1", "il04", "pl2")]


def test_frontier_asks_again_for_documents_without_plays(spark, tmp_path):
    a = nine("a")
    docs = {
        "cl1": game("cl1", ["A", "B"], ["1", "2"], [opening([lineup("A", a)]), play("1回表", "1番 a1", "左安")]),
        "cl2": game("cl2", ["A", "B"], ["1", "2"], [opening([lineup("A", a)])]),
    }
    stored = games.read_games(spark, write(tmp_path / "g", docs))
    asked = spark.createDataFrame([(f"https://s/{g}.html",) for g in ("cl1", "cl2", "cl3")], "url string")
    assert sorted(r.game_id for r in urls.pending(asked, stored).collect()) == ["cl2", "cl3"]


def test_page_grid(spark):
    teams = spark.createDataFrame([("Central", "G"), ("Pacific", "H")], "league string, team string")
    grid = urls.page_grid(teams, "https://s/%s/%s/p/%s_stat.htm", ["league", "team"])
    found = {r.url for r in grid.collect()}
    assert len(found) == 202 and "https://s/Central/G/p/00_stat.htm" in found and "https://s/Pacific/H/p/99_stat.htm" in found


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.shared_dir(spark) == named
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_a_cluster_session_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_files_with_different_headers_keep_their_columns_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿team,AB,H\nx,4,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("team,H,AB\ny,2,5\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("team,AB,H,HR\nz,6,3,1\n", encoding="utf-8")
    got = sorted(map(tuple, tables.read_table(spark, str(tmp_path)).select("team", "ab", "h", "hr").collect()))
    assert got == [("x", 4.0, 1.0, None), ("y", 5.0, 2.0, None), ("z", 6.0, 3.0, 1.0)]
