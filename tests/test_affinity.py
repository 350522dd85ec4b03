from __future__ import annotations

import numpy as np
import pytest

from scorebook.operators import affinity


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    h, p = rng.normal(size=(40, 8)), rng.normal(size=(60, 8))
    p[20:45] = p[20]  # a group of copies
    h_team = rng.integers(0, 3, 40)
    p_team = np.where(rng.random(60) < 0.4, 0, rng.integers(0, 3, 60))
    return h, p, h_team, p_team


def frames(spark, vectors):
    h, p, ht, pt = vectors
    left = spark.createDataFrame([(i, int(ht[i]), h[i].tolist()) for i in range(len(h))], "hitter int, h_team int, h_vec array<double>")
    right = spark.createDataFrame([(i, int(pt[i]), p[i].tolist()) for i in range(len(p))], "pitcher int, p_team int, p_vec array<double>")
    return left, right


def brute(vectors, top):
    h, p, ht, pt = vectors
    out = set()
    for i in range(len(h)):
        scored = sorted((-round(float(h[i] @ p[j]), 9), j) for j in range(len(p)) if ht[i] != pt[j])
        out |= {(i, j, rank) for rank, (_, j) in enumerate(scored[:top], 1)}
    return out


@pytest.mark.parametrize("top,block_rows", [(1, 8), (5, 8), (5, 1000), (30, 16), (100, 8)])
def test_rank_equals_brute_force(spark, vectors, top, block_rows):
    got = affinity.rank(*frames(spark, vectors), top, block_rows=block_rows)
    assert {(r.hitter, r.pitcher, r.rank) for r in got.collect()} == brute(vectors, top)


def test_no_pair_of_one_team_and_no_unknown_team(spark, vectors):
    left, right = frames(spark, vectors)
    left = left.selectExpr("hitter", "nullif(h_team, 2) as h_team", "h_vec")
    got = affinity.rank(left, right, 100).collect()
    assert got and all(r.h_team != r.p_team and r.h_team is not None for r in got)


def test_given_pairs(spark, vectors):
    h, p, ht, pt = vectors
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(70)], "hitter int, pitcher int")
    got = {(r.hitter, r.pitcher): r.score for r in affinity.pair_scores(pairs, *frames(spark, vectors), 8).collect()}
    want = {(i, j): float(h[i] @ p[j]) for i in range(5) for j in range(60) if ht[i] != pt[j]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_report_lines(spark, vectors):
    ranked = affinity.rank(*frames(spark, vectors), 2)
    lines = affinity.affinity_report(ranked).filter("hitter = 0").orderBy("line_no").collect()
    assert len(lines) == 4 and lines[0].line.startswith("【打者】0 (") and lines[-1].line == "-" * 60
    first = ranked.filter("hitter = 0 and rank = 1").first()
    assert lines[1].line == f"  vs {first.pitcher!s:12} ({first.p_team!s:2}) | Score: {first.score:10.6f}"


def test_fm_interaction_equals_the_sum_over_pairs(spark):
    rng = np.random.default_rng(5)
    groups = {g: rng.normal(size=(n, 2)) for g, n in (("a", 3), ("b", 1), ("c", 40))}
    df = spark.createDataFrame([(g, v.tolist()) for g, vs in groups.items() for v in vs], "g string, v array<double>")
    got = {r.g: r.interaction for r in affinity.fm_interaction(df, ["g"], "v").collect()}
    for g, vs in groups.items():
        want = sum(float(vs[i] @ vs[j]) for i in range(len(vs)) for j in range(i + 1, len(vs)))
        assert abs(got[g] - want) < 1e-9


def test_vectors_of_another_length_are_an_error(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(affinity.dot(F.col("a"), F.col("b"), 3)).first()[0] == 6.0
    with pytest.raises(Exception, match="has not the length 2"):
        df.select(affinity.dot(F.col("a"), F.col("b"), 2)).collect()


@pytest.mark.parametrize("top,block_rows", [(1, 8), (5, 8), (5, 1000), (30, 16), (100, 8)])
def test_rank_by_bounds_equals_brute_force(spark, vectors, top, block_rows):
    got = affinity.rank_by_bounds(*frames(spark, vectors), top, block_rows=block_rows)
    assert {(r.hitter, r.pitcher, r.rank) for r in got.ranked.collect()} == brute(vectors, top)


def test_short_vectors_are_not_met(spark):
    rng = np.random.default_rng(7)
    h, p = rng.normal(size=(64, 6)), rng.normal(size=(512, 6))
    p *= (10.0 / np.arange(1, 513))[:, None]
    same = h, p, rng.integers(0, 4, 64), rng.integers(0, 4, 512)
    got = affinity.rank_by_bounds(*frames(spark, same), 3, block_rows=16)
    assert {(r.hitter, r.pitcher, r.rank) for r in got.ranked.collect()} == brute(same, 3)
    rounds = sorted(tuple(r) for r in got.rounds.collect())
    assert [r[1] for r in rounds] == [1, 2, 4, 8, 16, 1] and rounds[0][4] == 0
    assert all(r[2] == r[3] + r[4] for r in rounds) and sum(r[3] for r in rounds) < sum(r[2] for r in rounds) / 4


def test_bounds_without_pitchers_and_with_equal_lengths(spark):
    left, right = frames(spark, (np.ones((3, 2)), np.ones((9, 2)), np.zeros(3, int), np.ones(9, int)))
    assert affinity.rank_by_bounds(left, right.limit(0), 2).ranked.count() == 0
    got = affinity.rank_by_bounds(left, right, 2, block_rows=2).ranked.collect()
    assert sorted((r.hitter, r.pitcher, r.rank) for r in got) == [(i, j, j + 1) for i in range(3) for j in range(2)]
