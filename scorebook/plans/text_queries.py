"""Scalar and filter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions import classify, text
from scorebook.operators import tries
from scorebook.operators.summary import count_with_total
from scorebook.plans import sql, views
from scorebook.plans.registry import ORACLES, query
from scorebook.plans.views import table
from scorebook.session import scratch_path

# A mark made from the account balance, to decode.
_MARK = "CASE WHEN c_acctbal < 0 THEN '*' WHEN c_acctbal > 5000 THEN '+' ELSE '' END"


@query(
    "decode_marks",
    f"""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '左打' WHEN c_acctbal > 5000 THEN '両打' ELSE '右打' END AS hand
    FROM customer""",
)
def decode_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "customer").withColumn("mark", F.expr(_MARK))
    return marked.select("c_custkey", text.decode_hand(F.col("mark")).alias("hand"))


@query(
    "clean_names",
    """SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part""",
)
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("*"), F.replace(F.col("p_name"), F.lit(" "), F.lit("　 ")), F.lit("+"))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_name(dirty).alias("name"))


@query(
    "parse_int_lenient",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN 0 ELSE CAST(floor(l_extendedprice) AS INT) END AS n
    FROM lineitem""",
)
def parse_int_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = F.format_number(F.floor("l_extendedprice"), 0)
    cell = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_linestatus") == "O", "").otherwise(grouped)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.lenient_int(cell).alias("n")
    )


@query(
    "parse_int_strict",
    """SELECT o_orderkey, CAST(o_orderpriority[1:1] AS INT) AS a, CAST(o_custkey AS INT) AS b
    FROM orders WHERE o_orderstatus <> 'P'""",
)
def parse_int_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = text.strict_int(F.substring("o_orderpriority", 1, 1))
    shown = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), text.strict_int(shown).alias("b"))
    return parsed.dropna(subset=["a", "b"])


@query(
    "concat_parts",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.' || CAST(l_linenumber % 3 AS VARCHAR) AS innings
    FROM lineitem""",
)
def concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("l_quantity").cast("int").cast("string")
    rest = F.concat(F.lit("."), (F.col("l_linenumber") % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(whole, rest).alias("innings")
    )


@query(
    "sentinel_replace",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 9.99 ELSE CAST(o_custkey AS DOUBLE) END AS era FROM orders""",
)
def sentinel_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("o_orderstatus") == "O", "-").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.sentinel(cell).try_cast("double").alias("era"))


@query(
    "fullwidth_int",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity AS INT) END AS runs FROM lineitem""",
)
def fullwidth_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.col("l_quantity").cast("int").cast("string")
    wide = F.translate(digits, text.ASCII_DIGITS, text.FULLWIDTH_DIGITS)
    shown = (
        F.when(F.col("l_returnflag") == "R", wide).when(F.col("l_returnflag") == "A", digits).otherwise("Ｘ")
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.fullwidth_int(shown).alias("runs")
    )


@query(
    "normalize_team",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'DeNA' ELSE c_mktsegment END AS team FROM customer""",
)
def normalize_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("c_mktsegment") == "BUILDING", "ＤｅＮＡ").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_team(shown).alias("team"))


_TEAM_OF_NATION = {0: "巨人", 1: "阪神", 2: " ＤｅＮＡ", 3: "広島", 4: "ヤクルト ", 5: "中日", 6: "ソフトバンク",
                   7: "ロッテ", 8: "日本ハム", 9: "西武", 10: "楽天", 11: "オリックス", 12: "横浜"}
_CODE_OF_NATION = {0: "G", 1: "T", 2: "DB", 3: "C", 4: "S", 5: "D", 6: "H", 7: "M", 8: "F", 9: "L", 10: "E",
                   11: "B", 12: "DB"}


@query(
    "map_codes",
    "SELECT c_custkey, CASE c_nationkey "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CODE_OF_NATION.items())
    + " ELSE 'N' || c_nationkey END AS code FROM customer",
)
def map_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    shown = F.coalesce(text.literal_map(_TEAM_OF_NATION)[nation], F.concat(F.lit("N"), nation.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.map_codes(shown).alias("code"))


@query(
    "encode_categories",
    "WITH " + sql.BATTERS + """
    SELECT team, name, CASE hand WHEN '左打' THEN 1 WHEN '両打' THEN 2 ELSE 0 END AS hand FROM batters""",
)
def encode_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = text.encode(F.col("hand"), text.BATTING_HANDS)
    return views.batters(spark, sf_dir).select("team", "name", coded.alias("hand"))


@query(
    "parse_batting_line",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS slot,
      CASE WHEN l_returnflag <> 'N' THEN 'p' || l_partkey END AS name,
      CASE WHEN l_returnflag <> 'A' THEN 'p' || l_partkey END AS token
    FROM lineitem""",
)
def parse_batting_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an ASCII space, with full-width digit and space, and without the slot mark."""
    number, name = F.col("l_linenumber").cast("string"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    wide = F.translate(number, text.ASCII_DIGITS, text.FULLWIDTH_DIGITS)
    line = (
        F.when(F.col("l_returnflag") == "R", F.concat(number, F.lit("番 "), name))
        .when(F.col("l_returnflag") == "A", F.concat(wide, F.lit("番　"), name))
        .otherwise(F.concat(F.lit("代打 "), name))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        text.batting_slot(line).alias("slot"),
        text.batting_name(line).alias("name"),
        text.second_token(line).alias("token"),
    )


@query(
    "inning_parse",
    """SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_linenumber AS VARCHAR) || '回' ||
        CASE l_linestatus WHEN 'F' THEN '表' ELSE '裏' END AS inning,
      l_linenumber AS inning_no, l_linestatus = 'F' AS is_top
    FROM lineitem WHERE l_returnflag <> 'N'""",
)
def inning_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = text.inning_label(F.col("l_linenumber"), F.col("l_linestatus") == "F")
    label = F.when(F.col("l_returnflag") == "N", "試合前").otherwise(built)
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber", label.alias("inning"))
        .filter(F.col("inning").contains("回"))
        .withColumns(
            {"inning_no": text.inning_number(F.col("inning")), "is_top": text.inning_is_top(F.col("inning"))}
        )
    )


@query(
    "parse_percent",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100, 1) AS share
    FROM lineitem WHERE l_returnflag <> 'N'""",
)
def parse_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("l_returnflag") == "N", "-").otherwise(
        F.concat(F.round(F.col("l_discount") * 100, 1).cast("string"), F.lit("%"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", text.percent(shown).alias("share"))
        .filter("share is not null")
    )


@query(
    "drop_placeholders",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 5 AS kind
    FROM lineitem WHERE l_linenumber % 5 >= 3 AND l_quantity < 50""",
)
def drop_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 5
    cell = F.when(kind == 0, "……").when(kind == 1, "\xa0").when(kind == 2, "---").otherwise("左安")
    name = F.when(F.col("l_quantity") < 50, F.col("l_partkey").cast("string")).otherwise("計")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumns({"cell": cell, "name": name, "kind": kind})
        .filter(~text.is_placeholder(F.col("cell")) & ~text.is_total_row(F.col("name")))
        .select("l_orderkey", "l_linenumber", "l_partkey", "kind")
    )


@query(
    "classify_deltas",
    "WITH " + sql.CLASSED + """
    SELECT result, cls, count(*) AS n, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(h) AS BIGINT) AS h,
      CAST(sum(tb) AS BIGINT) AS tb, CAST(sum(hr) AS BIGINT) AS hr, CAST(sum(bb) AS BIGINT) AS bb,
      CAST(sum(hbp) AS BIGINT) AS hbp, CAST(sum(sf) AS BIGINT) AS sf
    FROM counted GROUP BY result, cls""",
)
def classify_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_counts(spark, sf_dir, "literal")


@query("classify_by_table", ORACLES["classify_deltas"])
def classify_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same classes and counts with the rules read from a stored table."""
    place = scratch_path(spark, "rules")
    tries.rule_rows(spark, "literal").write.parquet(place)
    found = tries.classified(views.plays(spark, sf_dir).select("result"), spark.read.parquet(place))
    return found.groupBy("result", "cls").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in classify.MEASURES])


# Class of each result text in the shorthand of the logs, one by one.
_NOTATION = {
    "左安": "H1", "二安": "H1", "左２": "H2", "右３": "H3", "左本": "HR", "二ゴ": "OUT", "三振": "OUT", "遊ゴ": "OUT",
    "中飛": "OUT", "遊直": "OUT", "振逃": "OUT", "遊失": "OUT", "四球": "BB", "敬遠": "BB", "死球": "HBP", "左犠": "SF",
    "投ギ": "SAC", "三ギ": "SAC", "ギ失": "SAC", "一邪": "OUT", "遊併": "OUT", "三邪": "OUT", "三併": "OUT", "二併": "OUT",
}


@query(
    "classify_notation",
    "WITH " + sql.PLAYS + ", meaning(result, cls) AS (VALUES "
    + ", ".join(f"('{r}', '{c}')" for r, c in _NOTATION.items())
    + """), counted AS (SELECT plays.result, cls,
      CASE WHEN cls IN ('H1', 'H2', 'H3', 'HR', 'OUT') THEN 1 ELSE 0 END AS ab,
      CASE WHEN cls IN ('H1', 'H2', 'H3', 'HR') THEN 1 ELSE 0 END AS h,
      CASE cls WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 WHEN 'H3' THEN 3 WHEN 'HR' THEN 4 ELSE 0 END AS tb
      FROM plays JOIN meaning ON plays.result = meaning.result)
    SELECT result, cls, count(*) AS n, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(h) AS BIGINT) AS h,
      CAST(sum(tb) AS BIGINT) AS tb, count(*) FILTER (cls = 'HR') AS hr, count(*) FILTER (cls = 'BB') AS bb,
      count(*) FILTER (cls = 'HBP') AS hbp, count(*) FILTER (cls = 'SF') AS sf
    FROM counted GROUP BY result, cls""",
)
def classify_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_counts(spark, sf_dir, "notation")


@query(
    "classify_longform",
    "WITH " + sql.PLAYS + """, counted AS (
      SELECT result, CASE WHEN result IN ('四球', '敬遠') THEN 'BB' WHEN result = '死球' THEN 'HBP' ELSE 'OUT' END AS cls
      FROM plays)
    SELECT result, cls, count(*) AS n, count(*) FILTER (cls = 'OUT') AS ab, 0::BIGINT AS h, 0::BIGINT AS tb,
      0::BIGINT AS hr, count(*) FILTER (cls = 'BB') AS bb, count(*) FILTER (cls = 'HBP') AS hbp, 0::BIGINT AS sf
    FROM counted GROUP BY result, cls""",
)
def classify_longform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_counts(spark, sf_dir, "longform")


def _class_counts(spark: SparkSession, sf_dir: str, rules: str) -> DataFrame:
    played = views.plays(spark, sf_dir).select(
        "result",
        classify.play_class(F.col("result"), rules).alias("cls"),
        classify.deltas(F.col("result"), rules).alias("d"),
    )
    return played.groupBy("result", "cls").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"d.{m}").alias(m) for m in classify.MEASURES]
    )


@query(
    "count_with_total",
    "WITH " + sql.PLAYS + """
    SELECT coalesce(game_id, 'TOTAL') AS game_id, count(*) AS n FROM plays GROUP BY ROLLUP (game_id)""",
)
def plate_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate appearances per game and in all."""
    counted = views.plays(spark, sf_dir).filter(F.col("inning").contains("回"))
    # A roll-up total is counted as a sum of counts.
    return count_with_total(counted, "game_id").select("game_id", F.col("n").cast("bigint").alias("n"))
