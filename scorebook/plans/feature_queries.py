"""Feature assembly, scaling, splits, affinity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.operators import affinity, features, ordering, scaling, summary
from scorebook.plans import sql, views
from scorebook.plans.registry import query
from scorebook.plans.views import table
from scorebook.session import materialized

_RATES = ["avg", "hr", "slg", "ops"]


def _values(flat: DataFrame) -> DataFrame:
    return flat.select("game_id", "team", F.posexplode("vec").alias("pos", "value")).select(
        "game_id", "team", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


_A, _B = list(features.batter_columns("A")), list(features.batter_columns("B"))


@query(
    "assemble_flat",
    "WITH " + sql.SAMPLES + " SELECT game_id, team, pos, round(value, 6) AS value FROM ("
    + sql.flat_values(_A) + ")",
)
def assemble_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups joined with batter figures and the opposing starter, one vector per team."""
    return _values(views.flat_samples(spark, sf_dir, "A"))


@query(
    "feature_patterns",
    "WITH " + sql.SAMPLES + " SELECT game_id, team, pos, round(value, 6) AS value FROM ("
    + sql.flat_values(_B) + ")",
)
def feature_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors with hand and player types in place of raw figures."""
    return _values(views.flat_samples(spark, sf_dir, "B"))


_SEQUENCE = "WITH " + sql.SAMPLES + f""",
    steps AS (
      SELECT s.game_id, s.team, CAST(b.slot - 1 AS BIGINT) AS step,
        list_concat([{", ".join("b." + c for c in _A)}], {sql.PITCHER_VALUES}) AS v
      FROM samples s JOIN batted b ON s.game_id = b.game_id AND s.team = b.team),
    vals AS (SELECT game_id, team, step, i AS pos, v[i + 1] AS value FROM steps, range({len(_A) + 7}) r(i))"""


@query(
    "assemble_sequence",
    _SEQUENCE + " SELECT game_id, team, step, pos, round(value, 6) AS value FROM vals",
)
def assemble_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(views.sequences(spark, sf_dir, "A"))


def _steps(seqs: DataFrame) -> DataFrame:
    steps = seqs.select("game_id", "team", F.posexplode("seq").alias("step", "v"))
    return steps.select("game_id", "team", F.col("step").cast("bigint").alias("step"), F.posexplode("v").alias("pos", "value")).select(
        "game_id", "team", "step", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query(
    "standardize_pooled",
    _SEQUENCE + """,
    stats AS (SELECT pos, avg(value) AS m, stddev_pop(value) AS s FROM vals GROUP BY pos)
    SELECT game_id, team, step, v.pos, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS value
    FROM vals v JOIN stats t ON v.pos = t.pos""",
)
def standardize_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences scaled with statistics pooled over all steps."""
    seqs = materialized(views.sequences(spark, sf_dir, "A"), "sequences")
    return _steps(scaling.standardized_sequence(seqs, "seq", len(_A) + len(views.PITCHER_COLS)))


@query(
    "standardize_columns",
    "WITH " + sql.RATES + """,
    stats AS (SELECT avg(avg) AS m1, stddev_pop(avg) AS s1, avg(hr) AS m2, stddev_pop(hr) AS s2,
      avg(slg) AS m3, stddev_pop(slg) AS s3, avg(ops) AS m4, stddev_pop(ops) AS s4 FROM typed)
    SELECT team, name, round((avg - m1) / s1, 6) AS avg, round((hr - m2) / s2, 6) AS hr,
      round((slg - m3) / s3, 6) AS slg, round((ops - m4) / s4, 6) AS ops, 0.0::DOUBLE AS constant
    FROM typed CROSS JOIN stats""",
)
def standardize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates to zero mean and unit population deviation; a constant column becomes zeros."""
    rated = views.typed_batters(spark, sf_dir).withColumn("constant", F.lit(3.0))
    cols = [*_RATES, "constant"]
    scaled = scaling.standardized(rated, cols)
    return scaled.select("team", "name", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "sample_shape",
    "WITH " + sql.SAMPLES + f" SELECT count(*) AS samples, {views.flat_width('A')} AS width FROM samples",
)
def sample_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.shape(views.flat_samples(spark, sf_dir, "A"))


@query(
    "holdout_split",
    "WITH " + sql.SAMPLES + sql.SPLIT + " SELECT game_id, team, is_valid FROM split",
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = materialized(views.sample_keys(spark, sf_dir).select("game_id", "team"), "sample-keys")
    return ordering.with_holdout(samples, ["game_id", "team"])


@query(
    "baseline_mse",
    "WITH " + sql.SAMPLES + sql.SPLIT + """,
    m AS (SELECT avg(runs) AS m FROM split WHERE NOT is_valid)
    SELECT 'truncated' AS baseline, round(avg((runs - trunc(m)) ** 2), 6) AS mse FROM split, m WHERE is_valid
    UNION ALL SELECT 'exact', round(avg((runs - m) ** 2), 6) FROM split, m WHERE is_valid""",
)
def baseline_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of always answering the training mean, with and without its fraction."""
    samples = materialized(views.sample_keys(spark, sf_dir), "sample-keys")
    split = ordering.with_holdout(samples, ["game_id", "team"])
    train, valid = split.filter("not is_valid"), split.filter("is_valid")
    rows = [
        summary.mse(scaling.mean_baseline(train, valid, "runs", truncate), "runs", "prediction").select(
            F.lit(label).alias("baseline"), F.round("mse", 6).alias("mse")
        )
        for label, truncate in (("truncated", True), ("exact", False))
    ]
    return rows[0].unionByName(rows[1])


_TOP = 10
_RANKED = f"""
    emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    scored AS (
      SELECT h.vec_id AS hitter, h.label AS h_team, p.vec_id AS pitcher, p.label AS p_team,
        list_inner_product(h.v, p.v) AS exact
      FROM emb h JOIN emb p ON h.label <> p.label),
    ranked AS (
      SELECT hitter, h_team, pitcher, p_team, round(exact, 9) AS exact,
        CAST(row_number() OVER (PARTITION BY hitter ORDER BY exact DESC, pitcher) AS INT) AS rank FROM scored),
    best AS (SELECT * FROM ranked WHERE rank <= {_TOP})"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.rank(
        views.embedded(spark, sf_dir, "hitter", "h"), views.embedded(spark, sf_dir, "pitcher", "p"), _TOP
    )


@query(
    "affinity_rank",
    "WITH " + _RANKED + " SELECT hitter, h_team, pitcher, p_team, rank, exact AS score FROM best",
)
def affinity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pitchers of other teams each hitter suits best, over all vectors."""
    return _ranked(spark, sf_dir)


@query(
    "affinity_by_bounds",
    "WITH " + _RANKED + " SELECT hitter, h_team, pitcher, p_team, rank, exact AS score FROM best",
)
def affinity_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking, over blocks in falling order of length that are skipped where no score can reach the tenth."""
    return affinity.rank_by_bounds(
        views.embedded(spark, sf_dir, "hitter", "h"), views.embedded(spark, sf_dir, "pitcher", "p"), _TOP
    ).ranked


@query(
    "report_lines",
    "WITH " + _RANKED + """
    SELECT hitter, rank AS line_no,
      printf('  vs %-12s (%-2s) | Score: %10s', CAST(pitcher AS VARCHAR), CAST(p_team AS VARCHAR),
        CAST(CAST(CAST(exact AS DECIMAL(18, 9)) AS DECIMAL(18, 6)) AS VARCHAR)) AS line FROM best
    UNION ALL SELECT DISTINCT hitter, 0, '【打者】' || hitter || ' (' || h_team || ')' FROM best
    UNION ALL SELECT DISTINCT hitter, 2147483647, repeat('-', 60) FROM best""",
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.affinity_report(_ranked(spark, sf_dir))


@query(
    "affinity_scores",
    """WITH emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT hitter, h.label AS h_team, pitcher, p.label AS p_team, round(list_inner_product(h.v, p.v), 6) AS score
    FROM (SELECT DISTINCT l_partkey AS hitter, l_suppkey AS pitcher FROM lineitem)
    JOIN emb h ON hitter = h.vec_id JOIN emb p ON pitcher = p.vec_id WHERE h.label <> p.label""",
)
def affinity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every part and supplier that met on a line, where both have a vector."""
    met = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("hitter"), F.col("l_suppkey").alias("pitcher")
    )
    scored = affinity.pair_scores(
        met.distinct(), views.embedded(spark, sf_dir, "hitter", "h"), views.embedded(spark, sf_dir, "pitcher", "p"),
        views.EMBEDDING_WIDTH,
    )
    return scored.withColumn("score", F.round("score", 6))


@query(
    "fm_interaction",
    """WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
    sums AS (SELECT label, d, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY ALL)
    SELECT label, round(0.5 * sum(s * s - q), 4) AS interaction FROM sums GROUP BY label""",
)
def fm_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = affinity.fm_interaction(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return found.withColumn("interaction", F.round("interaction", 4))
