from __future__ import annotations

import numpy as np
import pytest

from scorebook.models import forests, regress

KIND = "i int, runs double, vec array<double>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    x[:, 1] = rng.integers(0, 3, 600)
    x[:, 3] = 7.0  # constant
    y = np.where(x[:, 0] > 0.2, 3.0, -1.0) + x[:, 1] + rng.normal(scale=0.3, size=600)
    return x, y


@pytest.fixture(scope="module")
def samples(spark, data):
    x, y = data
    return spark.createDataFrame([(i, float(v), r.tolist()) for i, (v, r) in enumerate(zip(y, x))], KIND)


def plain(bins, y, w, depth):
    """The errors of the best splits, one node after the other; the prediction of every row."""
    out = np.full(len(y), np.average(y, weights=w))
    squares = lambda k: np.sum(w[k] * (y[k] - np.average(y[k], weights=w[k])) ** 2)
    here, best = squares(np.ones(len(y), bool)), None
    for f in range(bins.shape[1]):
        for b in range(forests.BINS - 1):
            left = bins[:, f] <= b
            if left.any() and not left.all() and here - squares(left) - squares(~left) > (best or (1e-9,))[0] + 1e-9:
                best = here - squares(left) - squares(~left), left
    if best and depth:
        for side in (best[1], ~best[1]):
            out[side] = plain(bins[side], y[side], w[side], depth - 1)
    return out


@pytest.mark.parametrize("depth", [0, 2, 30])
def test_a_tree_takes_the_best_split_of_every_node(depth):
    rng = np.random.default_rng(5)
    bins, w = rng.integers(0, 32, (90, 3)).astype(np.uint8), rng.integers(1, 4, 90).astype(np.uint8)
    y = rng.normal(size=90) + bins[:, 1]
    tree, falls = forests.grow(bins, y, w, depth)
    np.testing.assert_allclose(tree.predict(bins), plain(bins, y, w.astype(float), depth), atol=1e-9)
    error = lambda p: np.sum(w * (y - p) ** 2)
    assert abs(falls.sum() - (error(np.average(y, weights=w)) - error(tree.predict(bins)))) < 1e-6


def test_both_searches_find_the_same_splits():
    rng = np.random.default_rng(6)
    node = np.sort(rng.integers(0, 40, 500))
    key, w, wy = node * forests.BINS + rng.integers(0, 32, 500), rng.integers(1, 4, 500).astype(float), rng.normal(size=500)
    n, s = np.bincount(node, w, 40), np.bincount(node, wy, 40)
    (fall, at), (other, there) = (search(key, w, wy, n, s) for search in (forests._dense, forests._sparse))
    np.testing.assert_allclose(fall, other, atol=1e-9)
    assert (at == there).all()


def test_of_equal_splits_the_first_feature_is_taken():
    rng = np.random.default_rng(8)
    for size in (2, 400):  # the same column thrice, in small and large nodes
        column, y = rng.integers(0, 32, size).astype(np.uint8), rng.normal(size=size)
        tree, falls = forests.grow(np.stack([column, 31 - column, column], axis=1), y, np.ones(size, np.uint8), 30)
        assert falls[0] > 0 == falls[1] == falls[2] and set(tree.feature) <= {-1, 0}


def test_draws_are_poisson_and_hang_on_row_and_tree():
    rows = np.arange(200_000)
    one, two = forests.drawn(rows, 0, 42), forests.drawn(rows, 1, 42)
    assert abs(one.mean() - 1) < 0.02 and abs(one.var() - 1) < 0.03 and abs(np.corrcoef(one, two)[0, 1]) < 0.02
    assert (forests.drawn(rows[::-1].copy(), 0, 42) == one[::-1]).all()


def test_a_deep_forest_needs_few_jobs_and_finds_what_counts(spark, samples, data):
    context = spark.sparkContext
    context.setJobGroup("deep forest", "")
    ready = regress.with_vector(samples)
    model = regress.forest(trees=20, depth=30).fit(ready)
    jobs = len(context.statusTracker().getJobIdsForGroup("deep forest"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[0] > 0.6 > shares[1] > shares[2] and shares[3] == 0
    got = {r.i: r.prediction for r in model.transform(ready).collect()}
    assert len(got) == 600 and np.mean([(got[i] - v) ** 2 for i, v in enumerate(data[1])]) < 0.1


def test_splits_over_all_tasks_and_rounds_grow_the_same_forest(samples):
    whole = forests.Forest(trees=6, depth=30).fit(samples)
    cut = forests.Forest(trees=6, depth=30, rows_a_unit=90, draws_a_round=1300).fit(samples.repartition(5))
    assert not whole.tops and len(cut.tops) == 6 and cut.units.count() > 20
    np.testing.assert_allclose(whole.importances, cut.importances, atol=0.02)
    one, two = ({r.i: r.prediction for r in m.transform(samples).collect()} for m in (whole, cut))
    assert np.mean([(one[i] - two[i]) ** 2 for i in one]) < 0.01 and len(one) == len(two) == 600


def test_large_nodes_without_a_gain_and_short_trees_are_leaves(spark, samples):
    flat = spark.createDataFrame([(i, 2.0, [float(i), 1.0]) for i in range(50)], KIND)
    for forest, df in ((forests.Forest(trees=2, rows_a_unit=5), flat), (forests.Forest(trees=2, depth=1, rows_a_unit=5), samples)):
        model = forest.fit(df)
        assert model.units.where("length(feature) > 4").count() == 0
        assert model.transform(df).where("prediction IS NULL").count() == 0
    assert {round(r.prediction, 9) for r in forests.Forest(trees=2, rows_a_unit=5).fit(flat).transform(flat).collect()} == {2.0}


def test_rows_that_do_not_fit_are_errors(spark):
    for bad in ([(0, None, [1.0])], [(0, 1.0, [1.0]), (1, 1.0, [1.0, 2.0])], [(0, 1.0, [1.0]), (1, 1.0, [None])]):
        with pytest.raises(Exception, match="null or NaN|has not"):
            forests.Forest(trees=1).fit(spark.createDataFrame(bad, KIND).coalesce(1))
    with pytest.raises(ValueError, match="no rows"):
        forests.Forest(trees=1).fit(spark.createDataFrame([], KIND))
