"""Season tables, dictionaries and keyed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.classify import MEASURES
from scorebook.functions.rates import group_sum, relative_power, with_rates
from scorebook.operators import corrections, features, lookup, running, summary, tries
from scorebook.plans import sql, views
from scorebook.plans.registry import ORACLES, query
from scorebook.plans.views import table
from scorebook.session import scratch_path
from scorebook.sources.tables import read_table, write_table


@query(
    "scan_csv_roundtrip",
    "WITH " + sql.BATTERS + "SELECT team, CAST(name AS VARCHAR) AS name, hand, ab::DOUBLE AS ab, hr::DOUBLE AS hr, sf::DOUBLE AS sf FROM batters",
)
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "batters-csv")
    write_table(views.batters(spark, sf_dir), path)
    return read_table(spark, path).select("team", "name", "hand", "ab", "hr", "sf")


@query(
    "dynamic_feature_columns",
    "WITH " + sql.SHARES + """
    SELECT CAST(name AS VARCHAR) AS name, feature, round(value, 6) AS value
    FROM wide UNPIVOT (value FOR feature IN ("pitch_ECONOMY_share", "pitch_LARGE_share", "pitch_MEDIUM_share",
      "pitch_PROMO_share", "pitch_SMALL_share", "pitch_STANDARD_share"))""",
)
def dynamic_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of a written table that is no key, whatever the header holds."""
    path = scratch_path(spark, "pitches-csv")
    write_table(views.pitch_table(spark, sf_dir), path)
    back = read_table(spark, path)
    cols = features.feature_columns(back)
    return back.unpivot("name", cols, "feature", "value").withColumn("value", F.round("value", 6))


@query(
    "id_dictionary",
    """SELECT name, row_number() OVER (ORDER BY name) - 1 AS id
    FROM (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier)""",
)
def id_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.id_dictionary(
        table(spark, sf_dir, "customer").select("c_name"), table(spark, sf_dir, "supplier").select("s_name")
    )


@query(
    "pivot_share",
    "WITH " + sql.SHARES + " SELECT team, name, "
    + ", ".join(f'round("pitch_{t}_share", 6) AS "pitch_{t}_share"' for t in views.PITCH_TYPES) + " FROM wide",
)
def pivot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = views.pitch_table(spark, sf_dir)
    return wide.withColumns({c: F.round(c, 6) for c in wide.columns if c.startswith("pitch_")})


@query(
    "group_column_sums",
    "WITH " + sql.SHARES + """
    SELECT team, name, round("pitch_LARGE_share" + "pitch_PROMO_share", 6) AS fast_group,
      round("pitch_MEDIUM_share" + "pitch_SMALL_share", 6) AS breaking_group,
      round("pitch_STANDARD_share" + "pitch_ECONOMY_share", 6) AS falling_group, 0.0::DOUBLE AS absent_group
    FROM wide""",
)
def group_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = views.pitch_table(spark, sf_dir)
    groups = {**views.PITCH_COLUMN_GROUPS, "absent": ["pitch_ABSENT_share"]}
    return wide.select(
        "team", "name", *[F.round(group_sum(wide, cols), 6).alias(f"{g}_group") for g, cols in groups.items()]
    )


@query(
    "rate_stats",
    "WITH " + sql.RATES + "SELECT team, name, avg, obp, slg, ops, isod FROM typed WHERE ab > 0",
)
def rate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rates(views.batters(spark, sf_dir), guard="filter").select(
        "team", "name", "avg", "obp", "slg", "ops", "isod"
    )


@query(
    "type_flags",
    "WITH " + sql.RATES
    + "SELECT team, name, type_power, type_avg, type_speed, type_eye, type_all FROM players",
)
def type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.typed_batters(spark, sf_dir).select(
        "team", "name", "type_power", "type_avg", "type_speed", "type_eye", "type_all"
    )


@query(
    "type_rosters",
    "WITH " + sql.RATES + """,
    member AS (
      SELECT 'type_power' AS type, team, name FROM players WHERE type_power = 1
      UNION ALL SELECT 'type_avg', team, name FROM players WHERE type_avg = 1
      UNION ALL SELECT 'type_speed', team, name FROM players WHERE type_speed = 1
      UNION ALL SELECT 'type_eye', team, name FROM players WHERE type_eye = 1
      UNION ALL SELECT 'type_all', team, name FROM players WHERE type_all = 1)
    SELECT type, team, name, count(*) OVER (PARTITION BY type) AS members FROM member""",
)
def type_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.rosters(views.typed_batters(spark, sf_dir))


@query(
    "relative_power",
    "WITH " + sql.TEAMS + "," + sql.RATES + "," + sql.PITCHERS + """
    SELECT l.game_id, l.team, l.slot, coalesce(b.avg, 0.0) - coalesce(p.era, 4.0) / 10 AS power
    FROM lineup l JOIN teams t ON l.game_id = t.game_id AND l.team = t.team
    LEFT JOIN players b ON l.name = b.name
    LEFT JOIN pitchers p ON t.starter = p.name""",
)
def relative_power_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    era = views.pitchers(spark, sf_dir).select(F.col("name").alias("starter"), "era")
    sides = views.stored_sides(spark, sf_dir)
    faced = views.teams_of(views.entries_of(sides)).join(era, "starter", "left")
    known = views.typed_batters(spark, sf_dir)
    batted = features.with_batters(views.slots_of(sides), known, ["avg"], keys=["name"])
    both = batted.join(faced, ["game_id", "team"])
    return both.select("game_id", "team", "slot", relative_power(F.col("avg"), F.col("era")).alias("power"))


@query(
    "league_average_row",
    "WITH " + sql.BATTERS + """, shown AS (
      SELECT team, CAST(name AS VARCHAR) AS name, ab, h, CASE WHEN hr > 0 THEN hr END AS hr FROM batters)
    SELECT team, name, ab::DOUBLE AS ab, h::DOUBLE AS h, hr::DOUBLE AS hr FROM shown
    UNION ALL SELECT 'ALL', 'AVERAGE_MEAN', avg(ab), avg(h), avg(hr) FROM shown
    UNION ALL SELECT 'ALL', 'AVERAGE_SUM', sum(ab) / count(*), sum(h) / count(*), sum(hr) / count(*) FROM shown""",
)
def league_average_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with both kinds of average row; they differ where a figure is missing."""
    shown = views.batters(spark, sf_dir).select(
        "team", F.col("name").cast("string").alias("name"), "ab", "h", F.when(F.col("hr") > 0, F.col("hr")).alias("hr")
    )
    with_mean = lookup.append_league_row(shown, {"team": "ALL", "name": "AVERAGE_MEAN"}, "mean")
    by_sum = lookup.league_average(shown, {"team": "ALL", "name": "AVERAGE_SUM"}, "sum")
    return with_mean.unionByName(by_sum)


@query(
    "dedupe_keep_first",
    """SELECT l_suppkey, l_linenumber, l_orderkey, l_partkey, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber
        ORDER BY l_orderkey, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity")
    return lookup.keep_first(rows, ["l_suppkey", "l_linenumber"], ["l_orderkey", "l_partkey", "l_quantity"])


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a unique table must not hold twice."""
    return lookup.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "left_join_zero_default",
    "WITH " + sql.LINEUP + "," + sql.RATES + """
    SELECT l.game_id, l.team, l.slot, coalesce(b.ab, 0) AS ab, coalesce(b.hr, 0) AS hr, coalesce(b.avg, 0) AS avg
    FROM lineup l LEFT JOIN players b ON l.name = b.name""",
)
def left_join_zero_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.typed_batters(spark, sf_dir)
    joined = features.with_batters(
        views.slots(spark, sf_dir), known, ["ab", "hr", "avg"], keys=["name"]
    )
    return joined.select("game_id", "team", "slot", "ab", "hr", "avg")


@query(
    "left_join_mean_default",
    "WITH " + sql.TEAMS + "," + sql.PITCHERS + """
    SELECT t.game_id, t.team, round(coalesce(p.era, m.era), 6) AS era,
      round(CASE WHEN p.name IS NULL THEN m.hand ELSE p.hand END, 6) AS hand,
      round(coalesce(p.fast_group, m.fast_group), 6) AS fast_group
    FROM teams t LEFT JOIN pitchers p ON p.name = t.starter
    CROSS JOIN (SELECT avg(era) AS era, avg(hand) AS hand, avg(fast_group) AS fast_group FROM pitchers) m""",
)
def left_join_mean_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    faced = views.feature_teams(spark, sf_dir)
    return faced.select("game_id", "team", *[F.round(c, 6).alias(c) for c in ("era", "hand", "fast_group")])


@query(
    "last_wins_lookup",
    "WITH " + sql.LINEUP + """
    SELECT game_id, team, arg_max(l_suppkey, rn) AS starter FROM ordered GROUP BY game_id, team""",
)
def last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir).select(
        "game_id", "team", *views.LINE_ORDER, F.col("l_suppkey").alias("starter")
    )
    return lookup.keep_last(rows, ["game_id", "team"], views.LINE_ORDER).select("game_id", "team", "starter")


@query(
    "last_source_wins",
    """WITH src AS (
      SELECT l_partkey AS name, l_suppkey AS team, 0 AS s, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT l_partkey, l_suppkey + 1000000, 1, l_orderkey FROM lineitem WHERE l_returnflag = 'N'
      UNION ALL SELECT l_partkey, l_suppkey + 2000000, 2, l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT name, max(team) AS team FROM src JOIN (SELECT name, max((s, o)) AS top FROM src GROUP BY name) USING (name)
    WHERE (s, o) = top GROUP BY name""",
)
def last_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to its last supplier; pending lines overwrite accepted ones, returned lines both."""
    rows = table(spark, sf_dir, "lineitem")

    def source(flag: str, shift: int) -> DataFrame:
        last = rows.filter(F.col("l_returnflag") == flag).groupBy("l_partkey", "l_orderkey").agg(
            F.max(F.col("l_suppkey") + shift).alias("team")
        )
        return last.select(F.col("l_partkey").alias("name"), "team", "l_orderkey")

    return lookup.last_source_wins([source("A", 0), source("N", 1_000_000), source("R", 2_000_000)], "name", "team", "l_orderkey")


@query(
    "opponent_self_join",
    "WITH " + sql.ENTRIES + """
    SELECT e.game_id, e.team, o.team AS opponent FROM entries e JOIN entries o
    ON e.game_id = o.game_id AND e.team <> o.team""",
)
def opponent_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_opponent(views.entries(spark, sf_dir), "game_id", "team", "pos").select(
        "game_id", "team", "opponent"
    )


@query(
    "semi_known_names",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""",
)
def semi_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    known = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return lookup.known_names(rows, known, ["l_suppkey"]).select(*rows.columns)


@query(
    "prefix_name_match",
    """WITH named AS (SELECT DISTINCT p_brand AS team, p_name || ' ' || p_type AS full_name FROM part),
    asked AS (SELECT DISTINCT p_brand AS team, p_name AS short_name FROM part
      UNION SELECT DISTINCT p_brand, p_name || ' ' || p_type[1:1] FROM part)
    SELECT a.team, a.short_name, min(n.full_name) AS full_name
    FROM asked a JOIN named n ON a.team = n.team AND starts_with(n.full_name, a.short_name)
    GROUP BY a.team, a.short_name HAVING count(*) = 1""",
)
def prefix_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unique_prefix_match(*_short_and_full(spark, sf_dir), "team", "short_name", "full_name")


@query("prefix_name_trie", ORACLES["prefix_name_match"])
def prefix_name_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches by a trie of the short names."""
    return tries.unique_prefix_match(*_short_and_full(spark, sf_dir), "team", "short_name", "full_name")


def _short_and_full(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    full = part.select(F.col("p_brand").alias("team"), F.concat_ws(" ", "p_name", "p_type").alias("full_name"))
    short = part.select(F.col("p_brand").alias("team"), F.col("p_name").alias("short_name")).unionByName(
        part.select(
            F.col("p_brand").alias("team"),
            F.concat_ws(" ", "p_name", F.substring("p_type", 1, 1)).alias("short_name"),
        )
    )
    return short, full


@query(
    "credit_fanout",
    "WITH " + sql.PLAYS + """, fan AS (
      SELECT 'both' AS credit, unnest([visitor, home]) AS team, game_id FROM plays
      UNION ALL SELECT 'last', home, game_id FROM plays
      UNION ALL SELECT 'batting', CASE WHEN is_top THEN visitor ELSE home END, game_id FROM plays)
    SELECT credit, game_id, team, count(*) AS n FROM fan GROUP BY ALL""",
)
def credit_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    played = views.plays(spark, sf_dir)
    counts = [
        running.credited(played, mode).groupBy("game_id", "team").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(mode).alias("credit"), "game_id", "team", "n"
        )
        for mode in ("both", "last", "batting")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_ASOF = """
    initial AS (
      SELECT team, name, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(h) AS BIGINT) AS h FROM (
        SELECT CASE WHEN user_id % 2 = 0 THEN '中日' ELSE 'DeNA' END AS team, 'u' || user_id AS name,
          10 AS ab, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS h FROM events) GROUP BY ALL),
    credited AS (SELECT *, {team} AS team FROM counted),
    played AS (
      SELECT game_id, team, name, sum(ab) AS ab, sum(h) AS h, sum(tb) AS tb, sum(hr) AS hr, sum(bb) AS bb,
        sum(hbp) AS hbp, sum(sf) AS sf FROM credited GROUP BY game_id, team, name),
    active AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CASE WHEN is_top THEN visitor ELSE home END AS team, name FROM plays),
    asked AS (
      SELECT DISTINCT 'cl' || strftime(day + CAST(x AS INT), '%Y%m%d') || '01' AS game_id, team, name
      FROM active, (VALUES (0), (1)) v(x))
    SELECT a.game_id, a.team, a.name,
      CAST(coalesce(max(i.ab), 0) + coalesce(sum(p.ab), 0) AS BIGINT) AS ab,
      CAST(coalesce(max(i.h), 0) + coalesce(sum(p.h), 0) AS BIGINT) AS h,
      CAST(coalesce(sum(p.tb), 0) AS BIGINT) AS tb, CAST(coalesce(sum(p.hr), 0) AS BIGINT) AS hr,
      CAST(coalesce(sum(p.bb), 0) AS BIGINT) AS bb, CAST(coalesce(sum(p.hbp), 0) AS BIGINT) AS hbp,
      CAST(coalesce(sum(p.sf), 0) AS BIGINT) AS sf
    FROM asked a
    LEFT JOIN played p ON p.team = a.team AND p.name = a.name AND p.game_id < a.game_id
    LEFT JOIN initial i ON i.team = a.team AND i.name = a.name
    GROUP BY a.game_id, a.team, a.name"""


def known_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each player is known for before the first game: signups as hits."""
    team = F.when(F.col("user_id") % 2 == 0, F.lit("中日")).otherwise(F.lit("DeNA"))
    per_user = table(spark, sf_dir, "events").groupBy(
        team.alias("team"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")
    ).agg((F.count(F.lit(1)) * 10).alias("ab"), F.count_if(F.col("event_type") == "signup").alias("h"))
    return per_user.withColumns({m: F.lit(0) for m in ("tb", "hr", "bb", "hbp", "sf")})


def _running(spark: SparkSession, sf_dir: str, credit: str) -> DataFrame:
    played = views.plays(spark, sf_dir)
    return running.running_stats(
        views.requests(played), played, known_before(spark, sf_dir), rules="literal", credit=credit
    )


@query(
    "asof_running_stats",
    "WITH " + sql.CLASSED + "," + _ASOF.format(team="CASE WHEN is_top THEN visitor ELSE home END"),
)
def asof_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting stats of every player before each game, the side at bat credited."""
    return _running(spark, sf_dir, "batting")


@query("asof_credit_both", "WITH " + sql.CLASSED + "," + _ASOF.format(team="unnest([visitor, home])"))
def asof_credit_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir, "both")


@query("asof_credit_last", "WITH " + sql.CLASSED + "," + _ASOF.format(team="home"))
def asof_credit_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir, "last")


# Days of the month whose games are played again with other results.
_CORRECTED = (3, 17)
_CORRECTED_PLAYS = (
    f"""corrected AS (
      SELECT * REPLACE (CASE WHEN day(ts) IN {_CORRECTED} THEN '{{"k": ' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 7 || '}}'
        ELSE props END AS props) FROM events),"""
    + sql.CLASSED.replace("FROM events", "FROM corrected")
)


@query(
    "asof_after_correction",
    "WITH " + _CORRECTED_PLAYS + "," + _ASOF.format(team="CASE WHEN is_top THEN visitor ELSE home END"),
)
def asof_after_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept totals before each game after some stored games were overwritten; equal to computing all of them anew."""
    events = table(spark, sf_dir, "events")
    wrong = F.dayofmonth("ts").isin(*_CORRECTED)
    again = events.where(wrong).withColumn("props", F.concat(F.lit('{"k": '), (views.event_key() + 7).cast("string"), F.lit("}")))
    played = views.plays_of(events)
    kept = corrections.PointInTime(
        spark, scratch_path(spark, "point-in-time"), ["team", "name"], "_order", MEASURES, len("202503"), "game_id"
    )
    order = running.order_key(F.col("game_id"))
    kept.build(views.requests(played).withColumn("_order", order), running.changes(played), known_before(spark, sf_dir))
    replayed = views.plays_of(again)
    kept.correct(replayed.select(order.alias("_order")).distinct(), running.changes(replayed))
    return kept.totals().drop("_order")


@query(
    "score_stats",
    "WITH " + sql.ENTRIES + """
    SELECT count(*) AS n, round(avg(runs), 6) AS mean, round(stddev_pop(runs), 6) AS std,
      round(var_pop(runs), 6) AS variance FROM entries""",
)
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = summary.score_stats(views.entries(spark, sf_dir))
    return stats.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "variance")])
