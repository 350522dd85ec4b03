"""The stages against plain versions, and the queries against their SQL."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from check_oracle import connect, difference
from conftest_llm import words
from pyspark.sql import functions as F
from test_neardup import plain as plain_groups

from scorebook.llm import decontaminate, lines, mixing, repetition
from scorebook.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    assert difference(QUERIES[name](spark, SF_DIR), oracle, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_return_every_row(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in corpus_pipeline.QUERIES


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[name] = docs
        out = stage(spark, docs, SF_DIR)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            kept = {r.doc_id for r in repetition.measure(seen[name]).where("kept").collect()}
            assert sorted(map(tuple, docs.collect())) == sorted(tuple(r) for r in seen[name].collect() if r.doc_id in kept)
        if name == "line_dedup":
            removed = {r.doc_id: r.n_lines - r.n_removed for r in lines.find(seen[name]).collect()}
            left = {r.doc_id: len([x for x in r.text.split("\n") if words(x)]) for r in docs.collect()}
            assert left == {i: n for i, n in removed.items() if n} and docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in seen[name].collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted({g[2] for g in plain_groups(rows)})
        if name == "decontamination":
            clean = decontaminate.find(seen[name], spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).where("NOT contaminated")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in clean.collect())
        if name == "source_mixing":
            taken = {r.doc_id: r.taken // r.size for r in mixing.find(seen[name]).collect() if r.taken}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == taken


def test_near_dedup_links_from_a_similarity_of_80_percent(spark):
    words_ = [[f"w{i}x{j}" for j in range(104)] for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words_)]
    rows += [(100 + i, " ".join(w[:30] + ["a"] + w[31:60] + ["b"] + w[61:])) for i, w in enumerate(words_)]  # 90 of 110 shingles
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g[2] for g in plain_groups(rows, 80)}) == list(range(40))


def test_the_pipeline_runs_and_accepts_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 50
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
