from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorebook.functions import classify

H1, H2, H3 = dict(ab=1, h=1, tb=1), dict(ab=1, h=1, tb=2), dict(ab=1, h=1, tb=3)
HR, OUT, NONE = dict(ab=1, h=1, tb=4, hr=1), dict(ab=1), {}
BB, HBP, SF = dict(bb=1), dict(hbp=1), dict(sf=1)

LITERAL = {
    "左安": H1, "二安": H2, "左２": NONE, "右３": NONE, "左本": HR, "二ゴ": H2, "三振": H3, "遊ゴ": OUT, "中飛": OUT,
    "遊直": OUT, "振逃": OUT, "遊失": OUT, "四球": BB, "敬遠": BB, "死球": HBP, "左犠": NONE, "投ギ": NONE,
    "三ギ": H3, "ギ失": OUT, "一邪": NONE, "遊併": NONE, "三邪": H3, "三併": H3, "二併": H2, "二本": H2, "犠飛": SF,
}
NOTATION = {
    "左安": H1, "二安": H1, "左２": H2, "右３": H3, "左本": HR, "二ゴ": OUT, "三振": OUT, "遊ゴ": OUT, "中飛": OUT,
    "遊直": OUT, "振逃": OUT, "遊失": OUT, "四球": BB, "敬遠": BB, "死球": HBP, "左犠": SF, "投ギ": NONE,
    "三ギ": NONE, "ギ失": NONE, "一邪": OUT, "遊併": OUT, "三邪": OUT, "三併": OUT, "二併": OUT,
}
LONGFORM = {
    "フォアボール": BB, "四球": BB, "敬遠": BB, "デッドボール": HBP, "死球": HBP,
    "ホームラン": dict(ab=1, h=1, tb=4), "本塁打": dict(ab=1, h=1, tb=4), "ヒット": H1, "安打": H1, "犠牲フライ": SF, "三振": OUT, "": OUT,
}


@pytest.mark.parametrize("rules,table", [("literal", LITERAL), ("notation", NOTATION), ("longform", LONGFORM)])
def test_every_result_text(spark, rules, table):
    df = spark.createDataFrame([(k,) for k in table], "r string")
    got = {r.r: r.d.asDict() for r in df.select("r", classify.deltas(F.col("r"), rules).alias("d")).collect()}
    want = {k: {m: v.get(m, 0) for m in classify.MEASURES} for k, v in table.items()}
    assert got == want


def test_rules_stay_in_the_jvm(spark):
    plan = spark.range(5).select(classify.deltas(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().toString()
    assert "Python" not in plan
