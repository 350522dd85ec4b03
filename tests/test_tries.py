from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scorebook.functions import classify
from scorebook.operators import lookup, tries

TEXTS = ["左安", "二ゴ", "三振", "遊ゴ", "四球", "敬遠四球", "死球", "犠飛", "野選", "フォアボール", "ホームラン", "ヒット", "右２", "投ギ", "?", "", None]


@pytest.mark.parametrize("rules", ["literal", "notation", "longform"])
def test_rules_from_a_table_equal_the_rules_in_code(spark, rules):
    df = spark.createDataFrame([(t,) for t in TEXTS * 2], "result string")
    got = tries.classified(df, tries.rule_rows(spark, rules))
    want = df.select("result", classify.play_class(F.col("result"), rules).alias("cls"), classify.deltas(F.col("result"), rules).alias("d"))
    want = want.select("result", "cls", *[F.col(f"d.{m}").alias(m) for m in classify.MEASURES])
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and key


def test_own_rules(spark):
    kind = "rank int, label string, marker string, " + ", ".join(f"{m} int" for m in classify.MEASURES)
    rules = spark.createDataFrame([(1, "B", "ab", 1, 0, 0, 0, 0, 0, 0), (0, "A", "abc", 2, 0, 0, 0, 0, 0, 0)], kind)
    got = {r.result: (r.cls, r.ab) for r in tries.classified(spark.createDataFrame([("xabcx",), ("xabx",), ("ba",)], "result string"), rules).collect()}
    assert got == {"xabcx": ("A", 2), "xabx": ("B", 1), "ba": ("NONE", 0)}


@pytest.mark.parametrize("depths", [None, [1, 2, 3, 4, 5, 6]])
def test_hits_equal_starts_with(spark, depths):
    r = random.Random(2)
    words = {(r.choice("xy"), "".join(r.choice("ab") for _ in range(r.randint(1, 6)))) for _ in range(25)}
    texts = [(i, r.choice("xy"), "".join(r.choice("ab") for _ in range(r.randint(0, 9)))) for i in range(60)]
    found = tries.hits(
        spark.createDataFrame(texts, "i int, s string, t string"), spark.createDataFrame(list(words), "s string, w string"), ["s"], "t", "w", depths
    )
    want = sorted((i, w) for i, s, t in texts for z, w in words if s == z and t.startswith(w))
    assert sorted((x.i, x._word) for x in found.collect()) == want


def test_unique_prefixes_equal_the_exploded_match(spark):
    r = random.Random(7)
    full = [(r.choice("AB"), "".join(r.choice("xyz") for _ in range(r.randint(1, 7)))) for _ in range(60)]
    short = [(t, n[: r.randint(1, 5)]) for t, n in full] + [("A", "nobody"), ("C", "x"), ("A", None)]
    sides = spark.createDataFrame(short, "team string, short string"), spark.createDataFrame(full, "team string, full string")
    got = tries.unique_prefix_match(*sides, "team", "short", "full").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, lookup.unique_prefix_match(*sides, "team", "short", "full").collect()))
