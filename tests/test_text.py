from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from scorebook.functions import text


def evaluate(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


CASES = [
    (text.decode_hand, ["*", "+", "", "x*+"], ["左打", "両打", "右打", "左打"]),
    (text.clean_name, ["岡 林　*", "+A B", "x"], ["岡林", "AB", "x"]),
    (text.lenient_int, ["1,234", "-", "", " 7 ", "x"], [1234, 0, 0, 7, None]),
    (text.strict_int, ["12", " 3", "-", "", "1,2"], [12, 3, None, None, None]),
    (text.fullwidth_int, ["０", "５", "10", "１０", "中止", None], [0, 5, 10, 10, None, None]),
    (text.percent, ["12.3%", "5%", "-"], [12.3, 5.0, None]),
    (text.sentinel, ["-", "3.10", ""], ["9.99", "3.10", ""]),
    (text.normalize_team, ["ＤｅＮＡ", "巨人", "x ＤｅＮＡ"], ["DeNA", "巨人", "x DeNA"]),
    (text.map_codes, [" 巨人 ", "ＤｅＮＡ", "横浜", "オリックス", "新球団"], ["G", "DB", "DB", "B", "新球団"]),
    (lambda c: text.encode(c, text.BATTING_HANDS), ["右打", "左打", "両打", "?", None], [0, 1, 2, 0, 0]),
    (lambda c: text.encode(c, text.THROWING_HANDS), ["右投", "左投", "不明", None], [0, 1, 0, 0]),
    (text.batting_slot, ["9番 東", "９番　東", "東", "番 東", "3番"], [9, 9, None, None, None]),
    (text.batting_name, ["9番 東", "９番　東 克", "東", ""], ["東", "東 克", None, None]),
    (text.second_token, ["9番 東", "代打 東 x", "東", "９番　東"], ["東", "東", None, None]),
    (text.inning_number, ["3回表", "１２回裏", "試合前"], [3, 12, None]),
    (text.inning_is_top, ["3回表", "3回裏", "試合前"], [True, False, None]),
    (text.game_id_from_url, ["https://s.example/a/cl2025032802.html", "x.htm"], ["cl2025032802", "x.htm"]),
    (text.url_to_file_name, ["https://s.example/a/pl1.html"], ["pl1.json"]),
    (text.game_date, ["cl2025032802", "x"], [datetime.date(2025, 3, 28), None]),
    (text.title_name, ["2024 投手成績 18 山田 太郎 - site", "何か"], ["山田 太郎", "不明"]),
    (text.throwing_hand, ["a 右投 左投", "左投", ""], ["右投", "左投", "不明"]),
    (text.is_placeholder, ["", "……", " ", "---", "\xa0", "左安"], [True] * 5 + [False]),
    (text.is_total_row, ["計", "合計", "山田"], [True, True, False]),
]


@pytest.mark.parametrize("fn,values,expected", CASES, ids=range(len(CASES)))
def test_column_functions(spark, fn, values, expected):
    assert evaluate(spark, fn, values) == expected


def test_numeric_hand_is_not_mapped_again(spark):
    df = spark.createDataFrame([(1,), (None,)], "hand int")
    assert [r[0] for r in df.select(text.encode_if_text(df, "hand", text.THROWING_HANDS)).collect()] == [1, 0]
    df = spark.createDataFrame([("左投",), (None,)], "hand string")
    assert [r[0] for r in df.select(text.encode_if_text(df, "hand", text.THROWING_HANDS)).collect()] == [1, 0]


def test_inning_label_round_trip(spark):
    df = spark.createDataFrame([(3, True), (10, False)], "n int, top boolean")
    labels = df.select(text.inning_label(F.col("n"), F.col("top")).alias("l"))
    assert [r.l for r in labels.collect()] == ["3回表", "10回裏"]
