"""Line-ups, documents and array operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions import text
from scorebook.operators import lineups
from scorebook.plans import sql, views
from scorebook.plans.registry import query
from scorebook.plans.views import table
from scorebook.session import scratch_path
from scorebook.sources import games, sinks


def _stored_documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events nested into documents, written as JSON lines and read back."""
    path = scratch_path(spark, name)
    sinks.write_games(views.documents(spark, sf_dir).drop("game_id"), path)
    return games.read_games(spark, path, multi_line=False)


def _game(document_id: str = "game_id"):
    """The game of a document's id."""
    return F.substring_index(document_id, "-", 1)


@query(
    "scan_nested_json",
    "WITH " + sql.PLAYS + """, runs AS (
      SELECT 'cl' || strftime(ts, '%Y%m%d') || '01' AS game_id,
        count(*) FILTER (event_type = 'purchase' AND user_id % 2 = 0) AS v,
        count(*) FILTER (event_type = 'purchase' AND user_id % 2 = 1) AS h FROM events GROUP BY 1)
    SELECT game_id, 0 AS pos, '中日' AS team, CAST(v AS INT) AS runs FROM runs
    UNION ALL SELECT game_id, 1, 'DeNA', CAST(h AS INT) FROM runs""",
)
def scan_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoreboards of stored documents, with runs in full-width digits."""
    stored = _stored_documents(spark, sf_dir, "games-json")
    return games.scores(stored).filter("runs IS NOT NULL").withColumn("game_id", _game())


@query(
    "readable_scores",
    "WITH " + sql.PLAYS + """, runs AS (
      SELECT 'cl' || strftime(ts, '%Y%m%d') || '01' AS game_id,
        count(*) FILTER (event_type = 'purchase' AND user_id % 2 = 0) AS v,
        count(*) FILTER (event_type = 'purchase' AND user_id % 2 = 1) AS h FROM events GROUP BY 1)
    SELECT game_id, 0 AS pos, CAST(v AS INT) AS runs FROM runs
    UNION ALL SELECT game_id, 1, CAST(h AS INT) FROM runs WHERE h % 2 = 0""",
)
def readable_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores up to the first unreadable one; odd second scores are made unreadable."""
    docs = views.documents(spark, sf_dir)
    odd = F.pmod(text.fullwidth_int(F.get("scoreboard", F.lit(1))["R"]), F.lit(2)) == 1
    broken = F.when(
        odd,
        F.array(
            F.get("scoreboard", F.lit(0)),
            F.struct(F.get("scoreboard", F.lit(1))["team"].alias("team"), F.lit("中止").alias("R")),
        ),
    ).otherwise(F.col("scoreboard"))
    return games.readable_scores(docs.withColumn("scoreboard", broken))


@query(
    "nest_documents",
    "WITH " + sql.PLAYS + """
    SELECT game_id, count(*) AS entries, min(name) AS first_name, max(result) AS last_result,
      count(DISTINCT name) AS names FROM plays GROUP BY game_id""",
)
def nest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents built from plays, summed up again per game."""
    docs = views.documents(spark, sf_dir)
    line = F.explode(F.transform("text_live", lambda e: e["plays"][0]["lines"])).alias("l")
    rows = docs.select("game_id", line).select(
        "game_id", text.batting_name(F.col("l")[0]).alias("name"), F.col("l")[1].alias("result")
    )
    return rows.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("name").alias("first_name"),
        F.max("result").alias("last_result"),
        F.countDistinct("name").alias("names"),
    )


@query(
    "unnest_plays",
    "WITH " + sql.PLAYS + """
    SELECT game_id, inning_no, is_top, slot, name, result, count(*) AS n FROM plays GROUP BY ALL""",
)
def unnest_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of stored documents; equal plays of a game are counted."""
    stored = _stored_documents(spark, sf_dir, "plays-json")
    return (
        games.appearances(stored)
        .groupBy(_game().alias("game_id"), "inning_no", "is_top", "slot", "name", "result")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "first_k_distinct",
    "WITH " + sql.LINEUP + " SELECT game_id, team, slot, name FROM lineup",
)
def first_k_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.slots(spark, sf_dir)


@query(
    "running_distinct_slot",
    "WITH " + sql.LINEUP + """, marked AS (
      SELECT o.game_id, o.team, o.name, o.l_suppkey, o.rn, CASE WHEN f.rn = o.rn THEN 1 ELSE 0 END AS is_first
      FROM ordered o JOIN firsts f ON o.game_id = f.game_id AND o.team = f.team AND o.name = f.name)
    SELECT game_id, team, name, l_suppkey,
      CAST(least(sum(is_first) OVER (PARTITION BY game_id, team ORDER BY rn), 3) AS INT) AS slot FROM marked""",
)
def running_distinct_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineups.running_slot(
        views.lines(spark, sf_dir), ["game_id", "team"], "name", ["l_linenumber"], k=views.K
    )
    return rows.select("game_id", "team", "name", "l_suppkey", "slot")


@query(
    "complete_groups",
    "WITH " + sql.LINEUP + """
    SELECT l.* FROM lineup l JOIN (SELECT game_id, team FROM lineup GROUP BY ALL HAVING count(*) = 3) c
    ON l.game_id = c.game_id AND l.team = c.team""",
)
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineups.complete(views.slots(spark, sf_dir), ["game_id", "team"], views.K)


@query(
    "filter_array_size",
    "WITH words AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) "
    "SELECT doc_id, len(w) AS words, w[1] AS first_word, w[2] AS second_word FROM words WHERE len(w) >= 20",
)
def filter_array_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("cells"))
    kept = split.filter(F.size("cells") >= 20)
    return kept.select(
        "doc_id",
        F.size("cells").cast("bigint").alias("words"),
        F.get("cells", F.lit(0)).alias("first_word"),
        F.get("cells", F.lit(1)).alias("second_word"),
    )
