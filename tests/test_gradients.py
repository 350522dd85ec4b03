from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from scorebook.models import gradients, regress


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    rows = [
        (rng.choice(12, rng.integers(0, 5), replace=False).tolist(), rng.normal(size=2).tolist(), float(rng.integers(0, 9)))
        for _ in range(300)
    ]
    sparse = regress.one_hot(spark.createDataFrame(rows, "ids array<int>, n array<double>, runs double"), "ids", 12, "n")
    dense = spark.createDataFrame([(Vectors.dense(rng.normal(size=14)), 2.0) for _ in range(20)], sparse.select("features", "runs").schema)
    return sparse.select("features", "runs").unionByName(dense).coalesce(2)


def test_a_fit_equals_that_of_spark(samples):
    settings = {"factors": 3, "epochs": 25, "step": 0.05, "decay": 0.1}
    want = regress.factorization(**settings).fit(samples)
    got, errors = regress.fit_fm(samples, samples, **settings)
    np.testing.assert_allclose(got.factors.toArray(), want.factors.toArray(), atol=1e-8)
    np.testing.assert_allclose(got.linear.toArray(), want.linear.toArray(), atol=1e-8)
    assert abs(got.intercept - want.intercept) < 1e-8
    predicted = want.transform(samples).collect()
    error = np.mean([(r.prediction - r.runs) ** 2 for r in predicted])
    assert all(abs(r.mse - error) < 1e-8 for r in errors.collect())


def test_matrices_and_lists_give_the_same_gradient():
    rng = np.random.default_rng(3)
    held = [rng.choice(6, k, replace=False) for k in (6, *rng.integers(0, 4, 39))]
    place = np.concatenate(held)
    given = (rng.normal(size=40), np.array([len(h) for h in held]), place, rng.normal(size=len(place)), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    for one, two in zip(gradients.block_gradient(*given), gradients.block_gradient(*given, dense=0)):
        np.testing.assert_allclose(one, two, atol=1e-9)


def test_what_spark_refuses_is_refused(samples):
    with pytest.raises(Exception, match="null or NaN"):
        regress.fit_fm(samples.selectExpr("features", "CAST(NULL AS double) AS runs"), samples, epochs=1)
    with pytest.raises(ValueError, match="no samples"):
        regress.fit_fm(samples.limit(0), samples, epochs=1)
    with pytest.raises(ValueError, match="adamW"):
        gradients.fit(regress.factorization().setSolver("gd"), samples)
