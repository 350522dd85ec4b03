from __future__ import annotations

import pytest
from check_oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    assert difference(queries()[name](spark, SF_DIR), oracle, ORACLES[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["asof_running_stats", "assemble_flat", "affinity_scores", "pivot_share", "type_rosters"])
def test_plans_have_no_cross_join_and_no_python_rows(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_running_totals_shuffle_their_steps_once(spark):
    df = queries()["asof_running_stats"](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("Scan parquet") == 3


def test_scans_read_only_the_columns_they_need(spark):
    plan = queries()["pivot_share"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("l_extendedprice" in s or "p_name" in s for s in scans)


def test_vectors_read_the_lines_once_per_grain(spark):
    """By order and by supplier before the plan, by part in it."""
    plan = queries()["assemble_flat"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "CartesianProduct" not in plan
