from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from scorebook import session
from scorebook.models import factorization
from scorebook.session import scratch_path

KIND = "i int, ids array<long>, numbers array<double>, runs double"


def machine(spark, vectors, own, bias, weights):
    size = len(next(iter(vectors.values())))
    rows = [(i, own[i], *map(float, v)) for i, v in vectors.items()]
    return factorization.Machine(
        bias, weights, spark.createDataFrame(rows, "id long, w double, " + ", ".join(f"v{f} double" for f in range(size))), size
    )


def formula(ids, numbers, vectors, own, bias, weights):
    out = bias + sum(w * x for w, x in zip(weights, numbers)) + sum(own.get(i, 0.0) for i in ids)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if ids[a] in vectors and ids[b] in vectors:
                out += float(np.dot(vectors[ids[a]], vectors[ids[b]]))
    return out


def test_predictions_are_sums_over_pairs_of_places(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=3) for i in range(8)}
    own = {i: float(rng.normal()) for i in range(8)}
    rows = [(n, [int(x) for x in rng.integers(0, 10, rng.integers(0, 7))], [float(x) for x in rng.normal(size=2)], 0.0) for n in range(60)]
    rows += [(100, [3, 3, 3], [0.0, 0.0], 0.0), (101, [], [1.0, 1.0], 0.0), (102, None, [1.0, 1.0], 0.0)]
    model = machine(spark, vectors, own, 0.7, (0.5, -1.0))
    got = {r.i: r.prediction for r in factorization.predict(spark.createDataFrame(rows, KIND), model, ["i"]).collect()}
    for n, ids, numbers, _ in rows:
        assert abs(got[n] - formula(ids or [], numbers, vectors, own, 0.7, (0.5, -1.0))) < 1e-9
    with pytest.raises(Exception, match="not 2 numbers"):
        factorization.predict(spark.createDataFrame([(1, [1], [1.0], 0.0)], KIND), model, ["i"]).collect()


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    strength, rows = rng.normal(size=12), []
    for i in range(300):
        ids = [int(x) for x in rng.integers(0, 12, 3)]
        x = float(rng.normal())
        rows.append((i, ids, [x], float(strength[ids].sum() + 0.8 * x + 4)))
    return spark.createDataFrame(rows, KIND)


def test_the_error_falls_with_every_epoch(spark, samples):
    fitted = factorization.fit(samples, ["i"], 1, size=2, epochs=6, step=2.0)
    assert len(fitted.errors) == 7 and all(a > b for a, b in zip(fitted.errors, fitted.errors[1:]))
    assert fitted.errors[-1] < fitted.errors[0] / 2
    predicted = factorization.predict(samples, fitted.machine, ["i"])
    error = np.mean([(r.prediction - r.runs) ** 2 for r in predicted.collect()])
    assert abs(error - fitted.errors[-1]) < 1e-9
    assert [r.epoch for r in factorization.error_rows(spark, fitted).orderBy("epoch").collect()] == list(range(7))


def test_the_step_follows_the_gradient(spark, samples):
    rows = [(r.i, r.ids, r.numbers, r.runs) for r in samples.limit(40).collect()]
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=2) for i in range(12)}
    own = {i: float(rng.normal()) for i in range(12)}
    df = spark.createDataFrame(rows, KIND)
    start = machine(spark, vectors, own, 0.1, (0.2,))
    moved = factorization._moved(factorization._off(df, start, ["i"], "runs"), start, len(rows), 1.0, 0.0, 1)

    def loss(vectors, own, bias, weights):
        return np.mean([(formula(ids, x, vectors, own, bias, weights) - y) ** 2 for _, ids, x, y in rows])

    base, h = loss(vectors, own, 0.1, (0.2,)), 1e-6
    got = {r.id: r for r in moved.factors.collect()}
    for i in (0, 5):
        nudged = {k: v.copy() for k, v in vectors.items()}
        nudged[i][1] += h
        assert abs((vectors[i][1] - got[i].v1) - (loss(nudged, own, 0.1, (0.2,)) - base) / h) < 1e-3
        assert abs((own[i] - got[i].w) - (loss(vectors, own | {i: own[i] + h}, 0.1, (0.2,)) - base) / h) < 1e-3
    assert abs((0.1 - moved.bias) - (loss(vectors, own, 0.1 + h, (0.2,)) - base) / h) < 1e-3
    assert abs((0.2 - moved.weights[0]) - (loss(vectors, own, 0.1, (0.2 + h,)) - base) / h) < 1e-3


def test_no_samples_and_the_same_start_on_every_run(spark, samples):
    with pytest.raises(ValueError, match="no samples"):
        factorization.fit(samples.limit(0), ["i"], 1)
    ids = spark.createDataFrame([(i % 5,) for i in range(20)] + [(None,)], "id long")
    one, two = (factorization.initial(ids.repartition(n), 0, 3).factors.orderBy("id").collect() for n in (1, 4))
    assert one == two and len(one) == 5 and max(abs(r.v0) for r in one) < 0.02


def test_a_fit_leaves_only_the_last_parameters(spark, samples):
    folder = Path(urlparse(scratch_path(spark, "any")).path).parent
    before = set(folder.glob("*"))
    fitted = factorization.fit(samples, ["i"], 1, size=2, epochs=3, step=200.0)  # steps are taken back too
    left = set(folder.glob("*")) - before
    assert len(fitted.steps) == 3 and fitted.steps[-1] < 200.0
    assert len(left) == 1 and next(iter(left)).name in fitted.machine.factors.inputFiles()[0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_only_scratch_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    session.discard(given)
    session.discard(spark.range(3))
    assert given.count() == 3
