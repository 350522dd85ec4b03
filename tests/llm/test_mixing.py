from __future__ import annotations

import random

import pytest
from conftest_llm import corpus, words
from pyspark.sql import functions as F

from scorebook.llm import mixing


def plain_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Shares by weight; what stands above its limit is cut off and shared again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if target[s] > most * sizes[s]} - capped
        if not above:
            return target
        capped |= above


def sized(rows):
    out = {}
    for r in rows:
        out[r[3]] = out.get(r[3], 0) + len(words(r[1]))
    return out


@pytest.fixture(scope="module")
def uneven(spark):
    """One source holds most rows, some are tiny."""
    r = random.Random(6)
    rows = [(i, x[1], x[2], r.choice(["big"] * 14 + ["b", "c", "d", None]), x[4]) for i, x in enumerate(corpus(7, 400))]
    rows = [(a, (b or "")[:600] or None, c, d, e) for a, b, c, d, e in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


@pytest.mark.parametrize("options", [{}, {"block_words": 100, "block_docs": 8, "shard_blocks": 10}])
def test_targets_sizes_and_taken_words(uneven, options):
    rows, docs = uneven
    sizes = sized(rows)
    want = plain_targets(sizes)
    got = mixing.find(docs, **options).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    taken, largest = {}, {}
    for r in got:
        source = by_id[r.doc_id][3]
        assert r.size == len(words(by_id[r.doc_id][1])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r.size)
    assert max(want[s] / sizes[s] for s in sizes) == 3.0  # a limit is reached
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.find(docs.repartition(7), **options)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_the_mix_holds_the_taken_copies_in_disjoint_shards(uneven):
    rows, docs = uneven
    options = {"block_words": 100, "block_docs": 8, "shard_blocks": 10}
    want = {r.doc_id: r.taken // r.size for r in mixing.find(docs, **options).collect() if r.taken}
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == [*docs.columns, *mixing.MADE]
    got = mixed.collect()
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.mix_pass)
    assert {i: len(c) for i, c in copies.items()} == want and all(len(set(c)) == len(c) for c in copies.values())
    shards = {r.mix_shard for r in got}
    assert len(shards) >= 8 and shards == set(range(len(shards)))
    orders = [(r.mix_shard, r.mix_order) for r in mixed.where(F.col("mix_shard") == 3).collect()]
    assert orders == sorted(orders)


def test_the_tree_keeps_every_quota_and_halves_every_node(spark):
    rows = [(s, p, b, None) for s, n in (("a", 90), ("b", 7), (None, 30)) for p in (1,) for b in range(n)]
    draws = spark.createDataFrame(rows, "_source string, _pass long, _block long, _upto double")
    quotas = mixing.shard_quotas(draws, 10, 5).collect()
    per_source, per_shard = {}, {}
    for q in quotas:
        per_source[q._source] = per_source.get(q._source, 0) + q._quota
        per_shard[q._shard] = per_shard.get(q._shard, 0) + q._quota
    assert per_source == {"a": 90, "b": 7, None: 30}
    assert len(per_shard) == 16 and set(per_shard.values()) <= {7, 8}
    dealt = mixing.dealt(draws, mixing.shard_quotas(draws, 10, 5), 5).collect()
    assert sorted((str(d._source), d._block) for d in dealt) == sorted((str(s), b) for s, _, b, _ in rows)
    counts = {}
    for d in dealt:
        counts[(d._source, d._shard)] = counts.get((d._source, d._shard), 0) + 1
    assert counts == {(q._source, q._shard): q._quota for q in quotas}


def test_empty_tables_nulls_and_clashing_columns(spark, empty, clashing):
    assert mixing.find(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.size, r.target, r.taken) for r in mixing.find(blank).collect()) == [(0, 0.0, 0)] * 2
    out = mixing.mix(clashing.withColumn("mix_shard", F.lit("own")))
    assert set(out.columns) == {*clashing.columns, *mixing.MADE} and out.count() > 0
    repeated = spark.createDataFrame([(1, "a b", "s")] * 5 + [(None, "c d e", "t")] * 3, "doc_id long, text string, source string")
    assert mixing.find(repeated).count() == 8


def test_no_python_on_the_executors(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
