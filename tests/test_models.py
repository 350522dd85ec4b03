from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from scorebook.models import regress
from scorebook.operators import affinity, ordering


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) * [1, 2, 3, 1, 5, 1] + [0, 1, 2, 0, 0, 4]
    x[:, 5] = 4.0  # constant
    y = x @ [1.5, 0.0, -0.7, 0.0, 0.2, 0.0] + 3 + rng.normal(scale=0.5, size=400)
    return x, y


@pytest.fixture(scope="module")
def samples(spark, data):
    x, y = data
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(len(y))]
    return spark.createDataFrame(rows, "game_id int, runs double, vec array<double>")


def standardized(x):
    std = x.std(0)
    return (x - x.mean(0)) / np.where(std > 0, std, 1)


def coordinate_descent(x, y, alpha, rounds=2000):
    w, n, yc = np.zeros(x.shape[1]), len(y), y - y.mean()
    for _ in range(rounds):
        for j in range(x.shape[1]):
            rest = yc - x @ w + x[:, j] * w[j]
            rho, norm = x[:, j] @ rest / n, (x[:, j] ** 2).mean()
            w[j] = 0.0 if norm == 0 else np.sign(rho) * max(abs(rho) - alpha, 0) / norm
    return w


def test_linear_equals_least_squares(samples, data):
    x, y = data
    model = regress.linear().fit(regress.with_vector(samples))
    design = np.c_[np.ones(len(y)), x[:, :5]]
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = [r.prediction for r in model.transform(regress.with_vector(samples)).orderBy("game_id").collect()]
    np.testing.assert_allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.5])
def test_lasso_equals_coordinate_descent(samples, data, alpha):
    x, y = data
    scaled, _ = regress.scaled_pair(samples, samples, 6)
    model = regress.lasso(alpha).fit(regress.with_vector(scaled))
    np.testing.assert_allclose(model.coefficients.toArray(), coordinate_descent(standardized(x), y, alpha), atol=1e-4)
    assert abs(model.intercept - y.mean()) < 1e-6


def test_scaling_scope(samples):
    half = samples.filter("game_id < 200")
    _, by_train = regress.scaled_pair(half, samples, 6, "train")
    _, by_all = regress.scaled_pair(half, samples, 6, "all")
    assert by_train.first().vec != by_all.first().vec
    with pytest.raises(ValueError):
        regress.scaled_pair(half, samples, 6, "none")


def test_comparison_table(samples, data):
    split = ordering.with_holdout(samples, ["game_id"])
    train, valid = split.filter("not is_valid"), split.filter("is_valid")
    got = {r.model: r.mse for r in regress.compare(train, valid, 6, regress.default_models(trees=10, depth=5)).collect()}
    assert list(got) == ["Baseline (Mean)", "Linear Regression", "Lasso Regression", "Random Forest"]
    assert got["Linear Regression"] < got["Random Forest"] < got["Baseline (Mean)"]


def test_pattern_table_counts_active_features(samples):
    split = ordering.with_holdout(samples, ["game_id"])
    pair = (split.filter("not is_valid"), split.filter("is_valid"), 6)
    narrow = tuple(f.withColumn("vec", F.slice("vec", 2, 1)) for f in pair[:2])
    got = {r.pattern: r for r in regress.compare_patterns({"A": pair, "B": (*narrow, 1)}).collect()}
    assert got["A"].dims == 6 and got["A"].active == 3 and got["B"].dims == 1
    assert got["A"].mse < got["B"].mse


def test_weights_are_ranked_with_their_direction(spark, samples):
    scaled, _ = regress.scaled_pair(samples, samples, 6)
    model = regress.lasso(0.1).fit(regress.with_vector(scaled))
    ranked = regress.weight_ranking(regress.weights(spark, model, list("abcdef")))
    rows = regress.ranking_lines(ranked).collect()
    assert [r.feature for r in rows] == ["c", "a", "e"]
    assert [r.impact for r in rows] == ["マイナス影響", "プラス貢献", "プラス貢献"]
    assert rows[0].line == f"{'c':20} | 係数: {rows[0].weight:7.4f} | マイナス影響"
    assert regress.weight_ranking(regress.weights(spark, model, list("abcdef")), top=1).count() == 1


def test_objective_rows(spark, samples):
    scaled, _ = regress.scaled_pair(samples, samples, 6)
    model = regress.lasso(0.1).fit(regress.with_vector(scaled))
    rows = regress.objective_rows(spark, model).orderBy("iteration").collect()
    assert rows and rows[-1].objective <= rows[0].objective
    assert all(r.iteration % 2 == 0 for r in regress.objective_rows(spark, model, 2).collect())


def test_models_survive_saving(samples, tmp_path):
    model = regress.linear().fit(regress.with_vector(samples))
    model.write().overwrite().save(str(tmp_path / "m"))
    back = LinearRegressionModel.load(str(tmp_path / "m"))
    np.testing.assert_array_equal(back.coefficients.toArray(), model.coefficients.toArray())


def test_one_hot(spark):
    df = spark.createDataFrame([([2, 0], [0.5, 1.5])], "ids array<int>, n array<double>")
    row = regress.one_hot(df, "ids", 4, "n").first()
    assert row.features.toArray().tolist() == [1, 0, 1, 0, 0.5, 1.5]
    assert regress.one_hot(df, "ids", 3).first().features.toArray().tolist() == [1, 0, 1]


def test_factorisation_learns_and_feeds_the_affinity_report(spark):
    rng = np.random.default_rng(2)
    strength = rng.normal(size=12)
    rows = []
    for _ in range(400):
        ids = rng.choice(12, 3, replace=False).tolist()
        rows.append((ids, [float(rng.normal())], float(strength[ids].sum())))
    df = spark.createDataFrame(rows, "ids array<int>, n array<double>, runs double")
    ready = regress.one_hot(df, "ids", 12, "n")
    model, errors = regress.fit_fm(ready, ready, factors=4, epochs=60, step=0.05, decay=0.0)
    variance = np.var([r[2] for r in rows])
    assert {r.side: r.mse for r in errors.collect()}["train"] < variance / 2
    factors = regress.factor_rows(spark, model, 12)
    left = factors.selectExpr("id as hitter", "id % 2 as h_team", "v as h_vec").filter("hitter < 6")
    right = factors.selectExpr("id as pitcher", "id % 2 as p_team", "v as p_vec").filter("pitcher >= 6")
    assert affinity.rank(left, right, 10).count() == 18
