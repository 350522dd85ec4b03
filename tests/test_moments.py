from __future__ import annotations

import numpy as np
import pytest
from test_models import coordinate_descent, standardized

from scorebook.models import moments, regress

WIDTH = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, WIDTH)) * [1, 2, 3, 1, 5, 1] + [0, 1, 2, 0, 1000, 4]
    x[:, 5] = 4.0  # constant
    x[:, 3] = 100 - x[:, 1] - x[:, 2]  # together with 1 and 2 always 100
    y = x @ [1.5, 0.4, -0.7, 0.0, 0.2, 0.0] + 3 + rng.normal(scale=0.5, size=900)
    return x, y, rng.random(900) < 0.2


@pytest.fixture(scope="module")
def samples(spark, data):
    x, y, valid = data
    rows = [(i, float(y[i]), x[i].tolist(), bool(valid[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "game_id int, runs double, vec array<double>, is_valid boolean").repartition(5)


@pytest.fixture(scope="module")
def sides(samples):
    return moments.split_moments(samples, WIDTH)


def test_moments_of_both_sides_from_one_pass(sides, data):
    x, y, valid = data
    for m, some in zip(sides, (~valid, valid)):
        rows = np.c_[x, y][some]
        assert m.n == some.sum()
        np.testing.assert_allclose(m.mean, rows.mean(0), rtol=1e-12)
        np.testing.assert_allclose(m.co, np.cov(rows.T, bias=True) * m.n, atol=1e-7)


def test_the_plan_reads_the_samples_once(samples):
    plan = moments.moment_rows(samples, WIDTH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def predictions(fit, x):
    return (x - fit.mean) / fit.std @ fit.weights + fit.intercept


def test_least_squares_without_full_rank(sides, data):
    x, y, valid = data
    fit = moments.least_squares(sides[0])
    design = np.c_[np.ones((~valid).sum()), standardized(x[~valid])]
    want = design @ np.linalg.lstsq(design, y[~valid], rcond=None)[0]
    np.testing.assert_allclose(predictions(fit, x[~valid]), want, atol=1e-7)
    np.testing.assert_allclose(fit.gradient, 0, atol=1e-9)
    np.testing.assert_allclose(fit.weights, np.linalg.lstsq(design, y[~valid], rcond=None)[0][1:], atol=1e-7)


@pytest.mark.parametrize("alpha", [0.05, 0.3, 2.0, 100.0])
def test_lasso_meets_its_conditions(sides, data, alpha):
    x, y, valid = data
    fit = moments.lasso(sides[0], alpha)
    z, rest = standardized(x[~valid]), y[~valid] - predictions(fit, x[~valid])
    gradient = z.T @ rest / len(rest)
    np.testing.assert_allclose(fit.gradient, gradient, atol=1e-9)
    active = fit.weights != 0
    np.testing.assert_allclose(gradient[active], alpha * np.sign(fit.weights[active]), atol=1e-9)
    assert (np.abs(gradient[~active]) <= alpha + 1e-9).all() and fit.weights[5] == 0
    assert all(a >= b - 1e-12 for a, b in zip(fit.objective, fit.objective[1:]))
    if alpha >= 0.3:  # one solution only
        np.testing.assert_allclose(predictions(fit, x[~valid]), z @ coordinate_descent(z, y[~valid], alpha) + y[~valid].mean(), atol=1e-5)



def test_the_same_lasso_as_the_iterative_estimator(samples, sides):
    train = samples.where("not is_valid")
    scaled, _ = regress.scaled_pair(train, train, WIDTH)
    model = regress.lasso(0.3).fit(regress.with_vector(scaled))
    np.testing.assert_allclose(moments.lasso(sides[0], 0.3).weights, model.coefficients.toArray(), atol=1e-3)


def test_errors_from_moments_alone(sides, data, spark):
    x, y, valid = data
    train, check = sides
    for fit in (moments.least_squares(train), moments.lasso(train, 0.2)):
        for m, some in ((train, ~valid), (check, valid)):
            assert abs(moments.mse(fit, m) - ((y[some] - predictions(fit, x[some])) ** 2).mean()) < 1e-8
    assert abs(moments.baseline_mse(train, check) - ((y[valid] - int(y[~valid].mean())) ** 2).mean()) < 1e-8
    table = {r.model: r.mse for r in moments.compare(spark, train, check).collect()}
    assert table["Linear Regression"] < table["Lasso Regression"] < table["Baseline (Mean)"]
    rows = {r.pattern: r for r in moments.compare_patterns(spark, {"A": sides}, 0.3).collect()}
    assert rows["A"].dims == WIDTH and rows["A"].active == int((moments.lasso(train, 0.3).weights != 0).sum())


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300) + 1e8
    y = 2 * (x - 1e8) + rng.normal(scale=0.01, size=300)
    rows = [(float(b), [float(a)], i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))]
    train, _ = moments.split_moments(spark.createDataFrame(rows, "runs double, vec array<double>, is_valid boolean").repartition(6), 1)
    fit = moments.least_squares(train)
    assert abs(fit.weights[0] / fit.std[0] - 2) < 1e-2


def test_nulls_widths_and_empty_sides(spark):
    kind = "runs double, vec array<double>, is_valid boolean"
    rows = [(1.0, [1.0], False), (2.0, [2.0], False), (None, [9.0], False), (4.0, None, True), (5.0, [3.0], None), (3.0, [3.0], True)]
    train, valid = moments.split_moments(spark.createDataFrame(rows, kind), 1)
    assert train.n == 2 and valid.n == 1
    with pytest.raises(Exception, match="length 1"):
        moments.split_moments(spark.createDataFrame([(1.0, [1.0, 2.0], False)], kind), 1)
    with pytest.raises(ValueError, match="both sides"):
        moments.split_moments(spark.createDataFrame(rows[:2], kind), 1)
