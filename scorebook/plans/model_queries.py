"""Regression models on the assembled features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.models import factorization, moments, regress, scaler
from scorebook.operators import features, ordering, scaling
from scorebook.plans import sql, views
from scorebook.plans.registry import query
from scorebook.plans.views import table
from scorebook.session import materialized, scratch_path

# Sizes of the forest and of the factorisation fit in the registered queries.
TREES, DEPTH = 100, 30
FM = {"factors": 16, "epochs": 100, "step": 0.01, "decay": 0.1}


def _moments(spark: SparkSession, sf_dir: str, pattern: str) -> tuple[moments.Moments, moments.Moments]:
    """Moments of the training and the validation side of a pattern's samples, from one pass over them."""
    samples = views.stored_samples(spark, sf_dir, pattern).select("game_id", "team", "runs", "vec")
    return moments.split_moments(ordering.with_holdout(samples, ["game_id", "team"]), views.flat_width(pattern))


def _names(pattern: str) -> list[str]:
    return features.flat_names(features.batter_columns(pattern), views.PITCHER_COLS, views.K)


def _named(pattern: str) -> str:
    """SQL list of the names of a pattern's places."""
    return "[" + ", ".join(f"'{n}'" for n in _names(pattern)) + "]"


_A, _B = (list(features.batter_columns(p)) for p in "AB")
_ALPHA, _FINE, _PATTERN_ALPHA = 0.1, 0.005, 0.05
_SWEEPS = 600
_WITH = "WITH RECURSIVE " + sql.SAMPLES + sql.SPLIT


@query(
    "ml_linear",
    _WITH + sql.gram(_A) + sql.conjugate() + f""",
    best AS (SELECT w FROM ols ORDER BY step DESC LIMIT 1)
    SELECT CAST(i - 1 AS INT) AS pos, ({_named("A")})[i] AS feature, round(w[i], 5) + 0 AS weight, 0.0::DOUBLE AS gradient
    FROM best, range(1, len(w) + 1) r(i)""",
)
def ml_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on the full vectors: weights, and the covariance of each feature with the residual, which is 0."""
    train, _ = _moments(spark, sf_dir, "A")
    return _rounded(moments.fit_rows(spark, moments.least_squares(train), _names("A")), 5)


def _rounded(rows: DataFrame, digits: int) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in ("weight", "gradient")})


_LASSO_ROWS = """
    SELECT CAST(i - 1 AS INT) AS pos, ({names})[i] AS feature, round(w[i], 5) + 0 AS weight,
      round(CASE WHEN w[i] <> 0 THEN sign(w[i]) * {alpha}::DOUBLE ELSE b[i] - list_dot_product(g[i], w) END, 5) + 0 AS gradient
    FROM best, g, range(1, len(w) + 1) r(i)"""


@query(
    "ml_lasso",
    _WITH + sql.gram(_A) + sql.sweeps(_ALPHA, _SWEEPS)
    + f", best AS (SELECT w FROM lasso WHERE step = {_SWEEPS})" + _LASSO_ROWS.format(names=_named("A"), alpha=_ALPHA),
)
def ml_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasso on the full vectors; the covariance with the residual is the penalty, signed, where a weight is not 0."""
    train, _ = _moments(spark, sf_dir, "A")
    return _rounded(moments.fit_rows(spark, moments.lasso(train, _ALPHA), _names("A")), 5)


def _split(spark: SparkSession, sf_dir: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    samples = views.stored_samples(spark, sf_dir, pattern).select(
        "game_id", "team", F.col("runs").cast("double"), "vec"
    )
    # The fits pass over the rows many times: they are dealt to all cores first.
    dealt = samples.repartition(spark.sparkContext.defaultParallelism, "game_id", "team")
    split = ordering.with_holdout(dealt, ["game_id", "team"])
    return split.filter("not is_valid"), split.filter("is_valid")


@query("ml_compare")
def ml_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _split(spark, sf_dir, "A")
    return regress.compare(
        train, valid, views.flat_width("A"), regress.default_models(trees=TREES, depth=DEPTH)
    )


@query("ml_forest")
def ml_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out error and feature importances of the forest."""
    train, valid = _split(spark, sf_dir, "A")
    with regress.kept(train, valid) as (train, valid):
        model = regress.forest(trees=TREES, depth=DEPTH).fit(regress.with_vector(train))
        error = regress.prediction_mse(model, regress.with_vector(valid)).first()["mse"]
    names = features.flat_names(features.batter_columns("A"), views.PITCHER_COLS, views.K)
    rows = [(n, float(w), error) for n, w in zip(names, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double, mse double")


@query(
    "linear_comparison",
    _WITH + sql.gram(_A) + sql.conjugate() + sql.sweeps(_ALPHA, _SWEEPS) + f""",
    best AS (SELECT w FROM ols ORDER BY step DESC LIMIT 1), sparse AS (SELECT w FROM lasso WHERE step = {_SWEEPS})
    SELECT 'Baseline (Mean)' AS model, (SELECT round(avg((runs - trunc(ym)) ** 2), 5) FROM split, label WHERE is_valid) AS mse
    UNION ALL SELECT 'Linear Regression', round({sql.valid_mse("best")}, 5)
    UNION ALL SELECT 'Lasso Regression', round({sql.valid_mse("sparse")}, 5)""",
)
def linear_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out errors of the baseline and of both linear models, all from one pass over the samples."""
    train, valid = _moments(spark, sf_dir, "A")
    return moments.compare(spark, train, valid, _ALPHA).withColumn("mse", F.round("mse", 5))


_PATTERN_ROW = """SELECT '{name}' AS pattern, CAST(len(w) AS INT) AS dims, CAST(len(list_filter(w, lambda x: x <> 0)) AS INT) AS active,
      round({mse}, 5) AS mse FROM best{name}"""


@query(
    "ml_patterns",
    _WITH + "".join(
        sql.gram(cols, p) + sql.sweeps(_PATTERN_ALPHA, _SWEEPS, p) + f", best{p} AS (SELECT w FROM lasso{p} WHERE step = {_SWEEPS})"
        for p, cols in (("A", _A), ("B", _B))
    ) + " UNION ALL ".join(_PATTERN_ROW.format(name=p, mse=sql.valid_mse(f"best{p}", p)) for p in "AB"),
)
def ml_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lasso per pattern: width, active features and hold-out error."""
    found = moments.compare_patterns(spark, {p: _moments(spark, sf_dir, p) for p in ("A", "B")}, _PATTERN_ALPHA)
    return found.withColumn("mse", F.round("mse", 5))


@query(
    "weight_ranking",
    _WITH + sql.gram(_B) + sql.sweeps(_FINE, _SWEEPS) + f""",
    best AS (SELECT w FROM lasso WHERE step = {_SWEEPS}),
    weights AS (SELECT CAST(i - 1 AS INT) AS pos, ({_named("B")})[i] AS feature, w[i] AS weight FROM best, range(1, len(w) + 1) r(i))
    SELECT pos, feature, round(weight, 4) AS weight, round(abs(weight), 4) AS abs_weight,
      CASE WHEN weight > 0 THEN 'プラス貢献' ELSE 'マイナス影響' END AS impact,
      CAST(row_number() OVER (ORDER BY abs(weight) DESC, pos) AS INT) AS place,
      printf('%-20s | 係数: %7.4f | %s', feature, round(weight, 4), impact) AS line
    FROM weights WHERE weight <> 0""",
)
def weight_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero lasso weights by size, as report lines."""
    train, _ = _moments(spark, sf_dir, "B")
    rows = moments.fit_rows(spark, moments.lasso(train, _FINE), _names("B")).drop("gradient")
    ranked = regress.weight_ranking(rows)
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("abs_weight"), "pos")))  # one row per feature
    return regress.ranking_lines(placed.withColumns({c: F.round(c, 4) for c in ("weight", "abs_weight")}))


@query(
    "scaler_applied",
    _WITH + sql.gram(_A) + """
    SELECT game_id, team, CAST(i - 1 AS INT) AS pos, round((v[i] - ms[i]) / ss[i], 6) + 0 AS value
    FROM vecs JOIN split USING (game_id, team), scale, range(1, (SELECT len(ms) + 1 FROM scale)) r(i) WHERE is_valid""",
)
def scaler_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the training side, saved, loaded again and applied to the other side."""
    train, valid = _split(spark, sf_dir, "A")
    place = scratch_path(spark, "scaler")
    scaler.Scaler(layout="vector", columns=["vec"], width=views.flat_width("A")).fit(train).save(place)
    scaled = scaler.ScalerModel.load(place).transform(valid)
    values = scaled.select("game_id", "team", F.posexplode("vec").alias("pos", "value"))
    return values.withColumn("value", F.round("value", 6) + F.lit(0.0))


_LOGGED = 40


@query(
    "objective_history",
    _WITH + sql.gram(_B) + sql.sweeps(_FINE, _LOGGED) + f"""
    SELECT CAST(step - 1 AS INT) AS iteration,
      round((yy - 2 * list_dot_product(w, b) + list_dot_product(w, list_transform(g, lambda row: list_dot_product(row, w)))) / 2
        + {_FINE}::DOUBLE * list_sum(list_transform(w, lambda x: abs(x))), 7) AS objective
    FROM lasso CROSS JOIN g WHERE step > 0""",
)
def objective_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lasso's objective after each of its first sweeps; it falls to the minimum."""
    train, _ = _moments(spark, sf_dir, "B")
    fit = moments.lasso(train, _FINE, sweeps=_LOGGED, tol=-1.0)
    return moments.objective_rows(spark, fit).withColumn("objective", F.round("objective", 7))


def _fm_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Line-up brands as ids, the opposing starter's figures as numbers."""
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("name"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand")
    )
    slots = views.slots(spark, sf_dir).join(brands, "name")
    ids = slots.groupBy("game_id", "team").agg(F.collect_set("brand").alias("ids"))  # at most K ids
    faced = scaling.standardized(views.feature_teams(spark, sf_dir), views.PITCHER_COLS)
    rows = ids.join(faced, ["game_id", "team"]).select(
        "game_id", "team", F.col("runs").cast("double"), "ids", F.array(*views.PITCHER_COLS).alias("numbers")
    )
    size = brands.agg(F.max("brand")).first()[0] + 1
    stored = materialized(rows, "fm-samples")
    split = ordering.with_holdout(regress.one_hot(stored, "ids", size, "numbers"), ["game_id", "team"])
    return split.filter("not is_valid"), split.filter("is_valid"), size


@query("ml_fm")
def ml_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the factorisation machine on both sides of the split."""
    train, valid, _ = _fm_samples(spark, sf_dir)
    _, errors = regress.fit_fm(train, valid, **FM)
    return errors


_GIVEN, _NUMBERS = 4, 2


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (order, line status) as a sample: its parts as players, with repeats, two figures, and its runs."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(
        F.collect_list("l_partkey").alias("ids"),  # an order has seven lines at most
        F.array(F.avg("l_discount"), F.avg("l_tax")).alias("numbers"), (F.sum("l_quantity").cast("bigint") % 10).alias("runs"),
    )


def _given(spark: SparkSession, sf_dir: str) -> factorization.Machine:
    value = lambda f: ((F.col("id") * 31 + 17 * f) % 41 - 20) / 100.0
    factors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).where("id % 10 <> 3")
    named = factors.select("id", value(9).alias("w"), *[value(f).alias(f"v{f}") for f in range(_GIVEN)])
    return factorization.Machine(0.5, (1.5, -2.0), named, _GIVEN)


@query(
    "fm_predict",
    f"""WITH f AS (
      SELECT p_partkey AS id, [{", ".join(f"((p_partkey * 31 + 17 * {f}) % 41 - 20) / 100.0" for f in (*range(_GIVEN), 9))}]::DOUBLE[] AS v
      FROM part WHERE p_partkey % 10 <> 3),
    x AS (SELECT l_orderkey, l_linestatus, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY ALL),
    e AS (SELECT l_orderkey, l_linestatus, unnest(v[1:{_GIVEN}]) AS v, generate_subscripts(v[1:{_GIVEN}], 1) AS d FROM lineitem JOIN f ON id = l_partkey),
    s AS (SELECT l_orderkey, l_linestatus, d, sum(v) AS s, sum(v * v) AS q FROM e GROUP BY ALL),
    i AS (SELECT l_orderkey, l_linestatus, sum(s * s - q) / 2 AS inter FROM s GROUP BY ALL),
    w AS (SELECT l_orderkey, l_linestatus, sum(v[{_GIVEN + 1}]) AS w FROM lineitem JOIN f ON id = l_partkey GROUP BY ALL)
    SELECT l_orderkey, l_linestatus, round(0.5 + 1.5 * a - 2.0 * b + coalesce(w, 0) + coalesce(inter, 0), 6) AS prediction
    FROM x LEFT JOIN i USING (l_orderkey, l_linestatus) LEFT JOIN w USING (l_orderkey, l_linestatus)""",
)
def fm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a factorisation machine with given parameters; parts without a row count as zeros."""
    keys = ["l_orderkey", "l_linestatus"]
    found = factorization.predict(_players(spark, sf_dir), _given(spark, sf_dir), keys)
    return found.select(*keys, F.round("prediction", 6).alias("prediction"))


@query("fm_training")
def fm_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a machine over parts after each epoch; it falls every time."""
    fitted = factorization.fit(_players(spark, sf_dir), ["l_orderkey", "l_linestatus"], _NUMBERS, size=8, epochs=5, step=1.0)
    return factorization.error_rows(spark, fitted)
