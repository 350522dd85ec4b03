"""The given tables read as game data.

events    -> plays: one game per day, a user is a player, the half is its parity
lineitem  -> an order is a game, its two line statuses are the teams, parts are
             batters, suppliers are pitchers
embeddings-> a vector is a player, its label the team
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.functions import text
from scorebook.functions.rates import Thresholds, with_pitch_groups, with_rates, with_types
from scorebook.operators import features, lineups, lookup, summary
from scorebook.session import dealt, materialized, tasks_beyond

# Line-up length of an order; a game of the sport has nine places.
K = 3
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
# Thresholds at which every flag is neither rare nor universal on these tables.
LIMITS = Thresholds(hr=3, slg=0.60, avg=0.33, sb=4, triples=2, isod=0.05, flags_for_all=3)
PITCH_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PITCH_COLUMN_GROUPS = {
    "fast": ["pitch_LARGE_share", "pitch_PROMO_share"],
    "breaking": ["pitch_MEDIUM_share", "pitch_SMALL_share"],
    "falling": ["pitch_STANDARD_share", "pitch_ECONOMY_share", "pitch_ABSENT_share"],
}
PITCHER_COLS = list(features.PITCHER_GROUPED)
# Result texts that stand for the 100 values of an event's property, in turn.
RESULTS = [
    "左安", "二安", "左２", "右３", "左本", "二ゴ", "三振", "遊ゴ", "中飛", "遊直", "振逃", "遊失",
    "四球", "敬遠", "死球", "左犠", "投ギ", "三ギ", "ギ失", "一邪", "遊併", "三邪", "三併", "二併",
]
VISITOR, HOME = "中日", "ＤｅＮＡ"


# Columns of the given tables; a declared schema saves a look into the files per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_key() -> Column:
    """The number inside an event's property text."""
    return F.get_json_object("props", "$.k").cast("int")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays_of(table(spark, sf_dir, "events"))


def plays_of(events: DataFrame) -> DataFrame:
    """Events as plays, with the columns of `games.plays` and the event's id."""
    top = F.col("user_id") % 2 == 0
    inning_no = F.floor(F.hour("ts") / 3).cast("int") + 1
    texts = F.array(*[F.lit(r) for r in RESULTS])
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("cl"), F.date_format("ts", "yyyyMMdd"), F.lit("01")).alias("game_id"),
        text.normalize_team(F.lit(VISITOR)).alias("visitor"),
        text.normalize_team(F.lit(HOME)).alias("home"),
        text.inning_label(inning_no, top).alias("inning"),
        inning_no.alias("inning_no"),
        top.alias("is_top"),
        (F.col("user_id") % 9 + 1).cast("int").alias("slot"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        F.element_at(texts, event_key() % len(RESULTS) + 1).alias("result"),
    )


def requests(plays_df: DataFrame) -> DataFrame:
    """Every player's own game days and the day after each of them."""
    at_bat = plays_df.select(
        F.to_date("ts").alias("day"),
        F.when(F.col("is_top"), F.col("visitor")).otherwise(F.col("home")).alias("team"),
        "name",
    ).distinct()
    both = at_bat.withColumn("day", F.explode(F.array("day", F.date_add("day", 1))))
    return both.select(
        F.concat(F.lit("cl"), F.date_format("day", "yyyyMMdd"), F.lit("01")).alias("game_id"), "team", "name"
    ).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events nested into game documents (the document schema, plus game_id).

    A game here is a day of events and has no bound, so its plays are documents
    of a natural unit: one batter in one half-inning, with both teams on every
    document. The runs of a game, its purchases in full-width digits, stand in a
    document of their own. The id in the url starts with the game's and a dash.
    """
    rows = plays(spark, sf_dir).withColumn(
        "lines",
        F.array(F.concat(F.col("slot").cast("string"), F.lit("番 "), F.col("name")), F.col("result")),
    )
    nested = lineups.nested(rows, ["game_id", "inning", "inning_no", "is_top", "name"], ["ts", "event_id", "lines"])
    bought = F.col("event_type") == "purchase"
    runs = table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("cl"), F.date_format("ts", "yyyyMMdd"), F.lit("01")).alias("game_id")
    ).agg(
        F.count_if(bought & (F.col("user_id") % 2 == 0)).alias("_visitor"),
        F.count_if(bought & (F.col("user_id") % 2 == 1)).alias("_home"),
    )

    def side(team: str, runs_: Column) -> Column:
        digits = F.translate(runs_.cast("string"), text.ASCII_DIGITS, text.FULLWIDTH_DIGITS)
        return F.struct(F.lit(team).alias("team"), digits.alias("R"))

    def url(*parts: Column) -> Column:
        return F.concat(F.lit("/score/"), F.concat_ws("-", "game_id", *parts), F.lit(".html")).alias("url")

    def board(visitor: Column, home: Column) -> Column:
        return F.array(side(VISITOR, visitor), side(HOME, home)).alias("scoreboard")

    no_pregame = F.lit(None).cast(
        "struct<lineups:array<struct<team:string,players:array<string>>>,pitchers:array<struct<team:string,name:string>>>"
    )
    half = F.concat(F.col("inning_no").cast("string"), F.when(F.col("is_top"), F.lit("t")).otherwise(F.lit("b")))
    live = F.transform(
        "entries",
        lambda e: F.struct(
            F.col("inning").alias("inning"),
            no_pregame.alias("pregame"),
            F.array(F.struct(e["lines"].alias("lines"))).alias("plays"),
        ),
    )
    played = nested.select("game_id", url(half, F.col("name")), board(F.lit(None), F.lit(None)), live.alias("text_live"))
    scored = runs.select(
        "game_id", url(F.lit("runs")), board(F.col("_visitor"), F.col("_home")),
        F.array().cast(played.schema["text_live"].dataType).alias("text_live"),
    )
    return played.unionByName(scored)


def batters(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """Season table of parts: counts over line items, hand from the size."""
    flag, qty, line = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_linenumber")
    hit = flag == "R"
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_linenumber")
    counts = dealt(sold, rows, "l_partkey").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("ab"),
        F.count_if(hit).alias("h"),
        F.count_if(hit & (qty > 45)).alias("hr"),
        F.count_if(hit & qty.between(41, 45)).alias("triples"),
        F.count_if((flag == "N") & (line == 1)).alias("bb"),
        F.count_if((flag == "N") & (line == 7)).alias("hbp"),
        F.count_if((flag == "N") & (line == 6)).alias("sf"),
        F.count_if((flag == "A") & (line <= 2)).alias("sb"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    hand = (
        F.when(F.col("p_size") % 7 == 0, F.lit("不明"))
        .when(F.col("p_size") % 3 == 0, F.lit("右打"))
        .when(F.col("p_size") % 3 == 1, F.lit("左打"))
        .otherwise(F.lit("両打"))
    )
    return counts.join(part, counts.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("team"),
        F.col("p_partkey").alias("name"),
        hand.alias("hand"),
        "ab", "h", "triples", "hr",
        (F.col("h") + 2 * F.col("triples") + 3 * F.col("hr")).alias("tb"),
        "sb", "bb", "hbp", "sf",
    )


def pitch_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (team, name, pitch_type, share) rows of suppliers; shares in percent."""
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    by_type = sold.join(kinds, "l_partkey").groupBy("l_suppkey", "p_type").agg(F.count(F.lit(1)).alias("n"))
    # The window spans one supplier's types, of which there are a handful.
    total = F.sum("n").over(Window.partitionBy("l_suppkey"))
    return by_type.select(
        (F.col("l_suppkey") % 12).alias("team"),
        F.col("l_suppkey").alias("name"),
        F.col("p_type").alias("pitch_type"),
        (F.col("n") * 100.0 / total).alias("share"),
    )


def pitch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.pivot_shares(
        pitch_shares(spark, sf_dir), ["team", "name"], "pitch_type", "share", PITCH_TYPES
    )


def pitchers(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """Season table of the suppliers: rates per nine lines and pitch groups, from one aggregate over their lines."""
    flag, kind = F.col("l_returnflag"), F.col("p_type")
    per_nine = lambda cond: F.count_if(cond) * 9.0 / F.count(F.lit(1))
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines_ = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    # The kinds are dealt, one row for each part; the lines follow them.
    sold = lines_.join(dealt(kinds, rows, "l_partkey"), "l_partkey", "left")
    figures = sold.groupBy(F.col("l_suppkey").alias("name")).agg(
        per_nine(flag == "R").alias("era"),
        per_nine(flag == "A").alias("k9"),
        per_nine((flag == "R") & (F.col("l_quantity") > 45)).alias("hr9"),
        # Shares are of the lines whose part is known; a supplier without one has no pitches and drops out.
        F.count(kind).alias("_known"),
        *[(F.count_if(kind == p) * 100.0 / F.nullif(F.count(kind), F.lit(0))).alias(f"pitch_{p}_share") for p in PITCH_TYPES],
    ).where("_known > 0")
    figures = figures.withColumn("team", F.col("name") % 12)
    hands = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("右投")).otherwise(F.lit("左投")).alias("hand"),
    )
    shares = [f"{g}_group" for g in PITCH_COLUMN_GROUPS]
    grouped = with_pitch_groups(figures, PITCH_COLUMN_GROUPS)
    return grouped.join(hands, "name").select("team", "name", "hand", "era", "k9", "hr9", *shares)


def coded_pitchers(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    return features.prepare_pitchers(pitchers(spark, sf_dir, rows), ["era"])


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of line items, from the files' footers: no line-ups have more slots."""
    return table(spark, sf_dir, "lineitem").count()


def sides(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """(game_id, team, runs, lines): an order's line statuses with their runs and their lines in order, seven at most."""
    sold = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linestatus").alias("team"), "l_quantity", *LINE_ORDER
    )
    return (
        dealt(sold, rows, "game_id", "team")
        .groupBy("game_id", "team")
        .agg(
            (F.sum("l_quantity").cast("bigint") % 10).alias("runs"),
            F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"),
        )
    )


def stored_sides(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """`sides` computed once, for queries that read both line-ups and scoreboards from it."""
    return materialized(sides(spark, sf_dir, rows), "sides")


def entries_of(sides_: DataFrame) -> DataFrame:
    last = F.element_at("lines", -1)["l_suppkey"].alias("starter")
    return sides_.select("game_id", "team", "runs", last, F.when(F.col("team") == "F", F.lit(0)).otherwise(F.lit(1)).alias("pos"))


def _names() -> Column:
    """The distinct parts of a side, by their first line."""
    return F.array_distinct(F.transform("lines", lambda line: line["l_partkey"]))


def slots_of(sides_: DataFrame) -> DataFrame:
    """The line-ups that `slots` gives."""
    placed = sides_.select("game_id", "team", F.posexplode(F.slice(_names(), 1, K)).alias("_i", "name"))
    return placed.select("game_id", "team", (F.col("_i") + 1).alias("slot"), "name")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoreboard: an order's line statuses with their runs and the supplier of their last line."""
    return entries_of(sides(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as box-score rows: game_id, team, name and the row order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linestatus").alias("team"),
        F.col("l_partkey").alias("name"),
        *LINE_ORDER,
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups: the first K distinct parts per order and line status."""
    # The part key follows the line number in LINE_ORDER, and it is the name that breaks ties.
    rows = lines(spark, sf_dir).select("game_id", "team", "name", "l_linenumber")
    return lineups.first_k_distinct(rows, ["game_id", "team"], "name", ["l_linenumber"], K).select(
        "game_id", "team", "slot", "name"
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game, team) rows of two-sided orders: runs, opponent and the opponent's starter."""
    return teams_of(entries(spark, sf_dir))


def teams_of(entries_: DataFrame) -> DataFrame:
    return lookup.with_opponent(entries_, "game_id", "team", "pos", carry=["starter"]).select(
        "game_id", "team", "runs", "opponent", F.col("opponent_starter").alias("starter")
    )


def typed_batters(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """Batters with hand code, rates and type flags."""
    return with_types(with_rates(features.prepare_batters(batters(spark, sf_dir, rows))), LIMITS)


def feature_slots(spark: SparkSession, sf_dir: str, pattern: str, sides_: DataFrame, rows: int = 0) -> DataFrame:
    """Slots of the line-ups that fill all places, which alone become samples, with the batter features of a pattern."""
    cols = features.batter_columns(pattern)
    full = sides_.where(F.size(_names()) >= K)
    batted = typed_batters(spark, sf_dir, rows).select("name", *cols)
    # Stored where lines are many or not counted, so that no task holds what counts the batters and what sorts the slots at once.
    if not rows or tasks_beyond(spark, rows):
        batted = materialized(batted, "batters")
    # The batters are dealt, one row for each; the slots follow them.
    return features.with_batters(slots_of(full), dealt(batted, rows, "name"), cols, keys=["name"])


def feature_teams(spark: SparkSession, sf_dir: str, sides_: DataFrame | None = None, rows: int = 0) -> DataFrame:
    known = teams(spark, sf_dir) if sides_ is None else teams_of(dealt(entries_of(sides_), rows, "game_id"))
    coded = materialized(coded_pitchers(spark, sf_dir, rows).drop("team"), "pitchers")  # read twice: rows and means
    return features.with_pitchers(known, dealt(coded, rows, "name"), PITCHER_COLS, keys=["starter"])


def flat_samples(spark: SparkSession, sf_dir: str, pattern: str = "A") -> DataFrame:
    """(game_id, team, runs, opponent, starter, vec) of complete line-ups."""
    rows = line_count(spark, sf_dir)
    sides_ = stored_sides(spark, sf_dir, rows)
    return features.flat(
        feature_slots(spark, sf_dir, pattern, sides_, rows), feature_teams(spark, sf_dir, sides_, rows),
        features.batter_columns(pattern), PITCHER_COLS, K, rows,
    )


def sequences(spark: SparkSession, sf_dir: str, pattern: str = "A") -> DataFrame:
    rows = line_count(spark, sf_dir)
    sides_ = stored_sides(spark, sf_dir, rows)
    return features.sequence(
        feature_slots(spark, sf_dir, pattern, sides_, rows), feature_teams(spark, sf_dir, sides_, rows),
        features.batter_columns(pattern), PITCHER_COLS, K, rows,
    )


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, team, runs) of the samples, without their features."""
    full = slots(spark, sf_dir).groupBy("game_id", "team").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == K)
    return teams(spark, sf_dir).select("game_id", "team", "runs").join(full.drop("_n"), ["game_id", "team"])


def stored_samples(spark: SparkSession, sf_dir: str, pattern: str = "A") -> DataFrame:
    """`flat_samples` assembled once and stored, for splits and fits that read them often."""
    return materialized(flat_samples(spark, sf_dir, pattern), f"samples-{pattern}")


def flat_width(pattern: str) -> int:
    return K * len(features.batter_columns(pattern)) + len(PITCHER_COLS)


def embedded(spark: SparkSession, sf_dir: str, name: str, prefix: str) -> DataFrame:
    """Every vector as a player of its label's team: (<name>, <prefix>_team, <prefix>_vec)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(name), F.col("label").alias(f"{prefix}_team"), F.col("embedding").alias(f"{prefix}_vec")
    )


EMBEDDING_WIDTH = 64
