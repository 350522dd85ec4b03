"""Page extraction, addresses and the incremental frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions import text
from scorebook.operators import lineups
from scorebook.plans import sql, views
from scorebook.plans.registry import query
from scorebook.plans.views import table
from scorebook.session import materialized
from scorebook.sources import markup, pages, urls

_PLAIN = """trim(replace(replace(replace(replace(replace(
  regexp_replace({x}, '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'))"""


@query(
    "html_elements_to_rows",
    f"""WITH li AS (
      SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1)) AS inner_html,
        generate_subscripts(regexp_extract_all(html, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1), 1) - 1 AS pos FROM pages)
    SELECT page_id, CAST(pos AS INT) AS pos, nullif(regexp_extract(inner_html, 'href="([^"]*)"', 1), '') AS href,
      {_PLAIN.format(x='inner_html')} AS label FROM li""",
)
def html_elements_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items with position, link and text."""
    items = pages.elements(table(spark, sf_dir, "pages"), "li")
    opening = F.regexp_extract("inner", r"<a([^>]*)>", 1)
    return items.select(
        "page_id", "pos", pages.attribute(opening, "href").alias("href"), pages.plain(F.col("inner")).alias("label")
    )


@query(
    "html_header_map",
    """WITH tags AS (
      SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<[A-Za-z][^>]*>') AS t FROM pages)),
    pairs AS (
      SELECT page_id, pos, unnest(regexp_extract_all(tag, '([A-Za-z-]+)="([^"]*)"', 1)) AS key,
        unnest(regexp_extract_all(tag, '([A-Za-z-]+)="([^"]*)"', 2)) AS value,
        generate_subscripts(regexp_extract_all(tag, '([A-Za-z-]+)="([^"]*)"', 1), 1) AS i FROM tags)
    SELECT page_id, CAST(pos AS INT) AS pos, key, arg_min(value, i) AS value FROM pairs GROUP BY ALL""",
)
def html_header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute name to value for every opening tag of a page."""
    tags = pages.all_matches(F.col("html"), r"<[A-Za-z][^>]*>", 0)
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.posexplode(tags).alias("pos", "tag"))
        .select("page_id", "pos", F.explode(pages.attribute_map(F.col("tag"))).alias("key", "value"))
    )


_VOID = "('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr','script','style')"
_TREE = rf"""
    t AS (
      SELECT page_id, regexp_extract_all(html,
        '(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|</?[a-z][^>]*>|<![^>]*>') AS tags FROM pages),
    u AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM t),
    n AS (
      SELECT *, lower(regexp_extract(tag, '^</?([A-Za-z][^\s/>]*)', 1)) AS name FROM u WHERE regexp_matches(tag, '^</?[A-Za-z]')),
    k AS (
      SELECT *, CASE WHEN tag LIKE '</%' THEN -1 WHEN name IN {_VOID} OR tag LIKE '%/>' THEN 0 ELSE 1 END AS step FROM n),
    opens AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY pos) AS level FROM k),
    closed AS (
      SELECT o.page_id, o.pos, min(c.pos) AS close FROM opens o JOIN opens c
        ON c.page_id = o.page_id AND c.name = o.name AND c.pos > o.pos AND c.level < o.level AND c.step = -1
      WHERE o.step = 1 GROUP BY ALL),
    e AS (SELECT k.page_id, k.pos, k.name, close FROM k LEFT JOIN closed c ON c.page_id = k.page_id AND c.pos = k.pos WHERE step >= 0)"""


@query(
    "html_tree",
    "WITH " + _TREE + """
    SELECT e.page_id, CAST(e.pos AS INT) AS pos, e.name, CAST(count(o.pos) AS INT) AS depth, CAST(max(o.pos) AS INT) AS parent,
      CAST(e.close AS INT) AS close
    FROM e LEFT JOIN e o ON o.page_id = e.page_id AND o.pos < e.pos AND o.close > e.pos GROUP BY e.page_id, e.pos, e.name, e.close""",
)
def html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and parent of every element of the raw pages."""
    return markup.tree(table(spark, sf_dir, "pages")).select("page_id", "pos", "name", "depth", "parent", "close")


@query(
    "title_extract",
    """WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)
    SELECT page_id, title, coalesce(nullif(trim(regexp_extract(title, '^(\\w+) (.*?) \\w', 2)), ''), '不明') AS name,
      contains(title, 'the') AS marked FROM t""",
)
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = pages.title_of(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        title.alias("title"),
        F.trim(text.title_name(title, r"^\w+ (.*?) \w")).alias("name"),
        title.contains("the").alias("marked"),
    )


@query(
    "extract_urls",
    """SELECT DISTINCT 'https://site.example' || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS url FROM pages""",
)
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.extract_urls(
        table(spark, sf_dir, "pages"), "html", r'href="(/[^"]*)"', "https://site.example", group=1
    )


@query(
    "url_to_game_id",
    r"""SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\.html$', '') AS game_id,
      regexp_replace(string_split(url, '/')[-1], '\.html$', '') || '.json' AS file_name FROM pages""",
)
def url_to_game_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.game_id_from_url(url).alias("game_id"), text.url_to_file_name(url).alias("file_name")
    )


@query(
    "game_dates",
    """SELECT event_id, CAST(ts AS DATE) AS day FROM events""",
)
def game_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date inside a game id."""
    game_id = F.concat(F.lit("pl"), F.date_format("ts", "yyyyMMdd"), F.lit("04"))
    return table(spark, sf_dir, "events").select("event_id", text.game_date(game_id).alias("day"))


@query(
    "incremental_frontier",
    """SELECT CAST(o_orderkey AS VARCHAR) AS game_id, '/score/' || o_orderkey || '.html' AS url FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)""",
)
def incremental_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a stored document that holds plays; only large lines count as plays."""
    asked = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/score/"), F.col("o_orderkey").cast("string"), F.lit(".html")).alias("url")
    )
    play = F.array(F.struct(F.array(F.lit("1番 p"), F.lit("左安")).alias("lines")))
    stored = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max("l_quantity").alias("q"))
        .select(
            F.col("l_orderkey").cast("string").alias("game_id"),
            F.array(F.struct(F.when(F.col("q") > 25, play).alias("plays"))).alias("text_live"),
        )
    )
    return urls.pending(asked, stored)


_NUMBERS = "list_concat(['00', '0'], [CAST(i AS VARCHAR) FOR i IN range(1, 100)])"


@query(
    "url_grid",
    f"""SELECT s_suppkey, number, 'https://site.example/' || r_name || '/' || n_name || '/p/' || s_suppkey || '_' || number || '.htm' AS url
    FROM (SELECT s_suppkey, r_name, n_name, unnest({_NUMBERS}) AS number
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
)
def url_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League, team and number to one address each."""
    clubs = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name", "n_name")
    )
    grid = urls.page_grid(clubs, "https://site.example/%s/%s/p/%s_%s.htm", ["r_name", "n_name", "s_suppkey"])
    return grid.select("s_suppkey", "number", "url")


def _row(cells: dict, width: int, first: str = "<tr class='x'>") -> Column:
    """One table row of `width` cells; cells without a value hold their number."""
    parts = [F.lit(first)]
    for i in range(width):
        value = cells[i] if i in cells else F.lit(str(i))
        parts += [F.lit("<td>"), value.cast("string"), F.lit("</td>")]
    return F.concat(*parts, F.lit("</tr>"))


# How the pages print their rows, cell by cell; the parsers keep positions of their own.
_PRINTED_WITH_HAND = (
    "mark", "name", "g", "pa", "ab", "r", "h", "doubles", "triples", "hr", "tb", "rbi", "sb", "cs", "sh", "sf", "bb", "ibb", "hbp",
)
_PRINTED_PLAIN = (
    "name", "g", "pa", "ab", "r", "h", "doubles", "triples", "hr", "tb", "rbi", "sb", "cs", "sh", "sf", "bb", "ibb", "hbp",
)
_BOX_FIRST_INNING = 9


def _shown(col: str) -> Column:
    """A count as pages print it: grouped digits, a dash for none."""
    return F.when(F.col(col) == 0, "-").otherwise(F.format_number(F.col(col), 0))


_HAND_SQL = "CASE hand WHEN '左打' THEN '左打' WHEN '両打' THEN '両打' ELSE '右打' END"


@query(
    "html_batter_rows",
    "WITH " + sql.BATTERS + f"""
    SELECT team, CAST(name AS VARCHAR) AS name, {_HAND_SQL} AS hand, ab::INT AS ab, h::INT AS h, triples::INT AS triples,
      hr::INT AS hr, tb::INT AS tb, sb::INT AS sb, bb::INT AS bb, hbp::INT AS hbp, sf::INT AS sf FROM batters""",
)
def html_batter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batters printed as page rows with hand marks and a total row, then read back."""
    start = '<tr class="ststats">'
    mark = F.when(F.col("hand") == "左打", "*").when(F.col("hand") == "両打", "+").otherwise("")
    name = F.concat(F.lit("<b>　"), F.col("name").cast("string"), F.lit(" </b>"))
    counts = {_PRINTED_WITH_HAND.index(c): _shown(c) for c in ("ab", "h", "triples", "hr", "tb", "sb", "bb", "hbp", "sf")}
    player = _row({0: mark, 1: name, **counts}, 20, start)
    total = _row({1: F.lit("計")}, 20, start)
    short = _row({}, 19, start)
    printed = views.batters(spark, sf_dir).select("team", F.concat(F.lit("<table>"), player, total, short).alias("html"))
    return pages.batters_with_hand(printed).drop("doubles")


@query(
    "html_batter_rows_plain",
    "WITH " + sql.BATTERS + """
    SELECT team, 'p' || name AS name, ab::INT AS ab, h::INT AS h, hr::INT AS hr, tb::INT AS tb, bb::INT AS bb,
      hbp::INT AS hbp, sf::INT AS sf FROM batters WHERE hbp > 0""",
)
def html_batter_rows_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout without hands; rows that print a dash anywhere are dropped."""
    cells = {_PRINTED_PLAIN.index(c): F.col(c) for c in ("ab", "h", "triples", "hr", "tb", "bb", "sf")}
    cells[_PRINTED_PLAIN.index("hbp")] = F.when(F.col("hbp") == 0, "-").otherwise(F.col("hbp").cast("string"))
    row = _row({**cells, 0: F.concat(F.lit("*p"), F.col("name").cast("string"))}, 18)
    head, tail = '<table class="tablefix2"><tbody>', "</tbody></table>"
    printed = views.batters(spark, sf_dir).select("team", F.concat(F.lit(head), row, F.lit(tail)).alias("html"))
    return pages.batters_plain(printed).drop("doubles", "triples")


@query(
    "html_pitcher_counts",
    """SELECT l_suppkey % 12 AS team, CAST(l_suppkey AS VARCHAR) AS name, CAST(count(*) AS VARCHAR) AS g,
      CAST(count(*) // 3 AS VARCHAR) || CASE count(*) % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.2' END AS ip,
      CAST(count(*) FILTER (l_returnflag = 'R') AS VARCHAR) AS h, CAST(count(*) FILTER (l_quantity > 45) AS VARCHAR) AS hr,
      CAST(count(*) FILTER (l_returnflag = 'A') AS VARCHAR) AS so,
      CASE WHEN l_suppkey % 5 = 0 THEN '9.99' ELSE CAST(count(*) FILTER (l_returnflag = 'N') AS VARCHAR) END AS era
    FROM lineitem GROUP BY l_suppkey""",
)
def html_pitcher_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers printed as pitcher rows; innings in two cells, some without an ERA."""
    flag = F.col("l_returnflag")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("g"),
        F.count_if(flag == "R").alias("h"),
        F.count_if(F.col("l_quantity") > 45).alias("hr"),
        F.count_if(flag == "A").alias("so"),
        F.count_if(flag == "N").alias("era"),
    )
    thirds = F.col("g") % 3
    cells = {
        1: F.concat(F.lit("　"), F.col("l_suppkey").cast("string")),
        2: F.col("g"), 13: F.floor(F.col("g") / 3), 15: F.col("h"), 16: F.col("hr"), 20: F.col("so"),
        14: F.when(thirds == 0, "").when(thirds == 1, ".1").otherwise(".2"),
        25: F.when(F.col("l_suppkey") % 5 == 0, "-").otherwise(F.col("era").cast("string")),
    }
    row = _row(cells, 26, '<tr class="odd ststats">')
    return pages.pitcher_counts(counts.select((F.col("l_suppkey") % 12).alias("team"), row.alias("html")))


@query(
    "html_pitcher_pages",
    "WITH " + sql.PITCHERS + """
    SELECT p.team, CAST(p.name AS VARCHAR) AS name, CASE hand WHEN 0 THEN '右投' ELSE '左投' END AS hand,
      round(era, 4) AS era, round(k9, 4) AS k9, CASE WHEN p.name % 2 = 0 THEN round(hr9, 4) ELSE 0.0 END AS hr9, """
    + ", ".join(f'round("pitch_{t}_share", 4) AS "pitch_{t}_share"' for t in views.PITCH_TYPES)
    + " FROM pitchers p JOIN wide w ON p.name = w.name",
)
def html_pitcher_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitcher pages printed and read back: title, hand, rates by header, pitch mix to columns."""

    def number(col: str) -> Column:
        return F.round(F.col(col), 4).cast("string")

    def mix_row(kind: str) -> Column:
        share = F.col(f"pitch_{kind}_share")
        shown = F.when(share == 0, "-").otherwise(F.concat(number(f"pitch_{kind}_share"), F.lit("%")))
        return _row({0: F.lit(kind), 2: shown}, 3)

    def wrap(before: str, inner: Column, after: str) -> Column:
        return F.concat(F.lit(before), inner, F.lit(after))

    has_hr9 = F.col("name") % 2 == 0
    wide = views.pitch_table(spark, sf_dir).drop("team")
    both = views.pitchers(spark, sf_dir).join(wide, "name")
    html = F.concat(
        wrap("<title>2024 投手成績 1 ", F.col("name").cast("string"), " - s</title>"),
        wrap("<p>", F.col("hand"), "</p>"),
        F.lit("<table><caption>通算成績(各種指標)</caption><tr><th>K/9</th>"),
        F.when(has_hr9, "<th>HR/9</th>").otherwise(""),
        wrap("</tr><tr><td>", number("k9"), "</td>"),
        F.when(has_hr9, wrap("<td>", number("hr9"), "</td>")).otherwise(""),
        wrap("</tr></table><table><tr><th>防御率</th></tr><tr><td>", number("era"), "</td></tr></table>"),
        F.lit("<table><tr><th>球種</th></tr>"),
        *[mix_row(k) for k in views.PITCH_TYPES],
        _row({0: F.lit("合計"), 2: F.lit("100%")}, 3),
        F.lit("</table>"),
    )
    return pages.pitcher_table(both.select("team", html.alias("html")), kinds=views.PITCH_TYPES)


@query(
    "box_score_plays",
    """SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS name, CAST(l_linenumber AS INT) AS inning_no,
      CASE l_linestatus WHEN 'F' THEN '表' ELSE '裏' END AS half, l_returnflag AS result, count(*) AS n
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL""",
)
def box_score_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as box scores and read back as plays.

    A line is a batter row whose result stands in the column of its line number;
    lines that were not returned nor accepted print a placeholder.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *views.LINE_ORDER, "l_linestatus", "l_returnflag")
    shown = F.when(F.col("l_returnflag") == "N", "……").otherwise(F.col("l_returnflag"))
    # As printed: name, place, then the figures up to the first inning, and as many innings as the data has.
    figures = F.lit("".join(f"<td>{i}</td>" for i in range(1, _BOX_FIRST_INNING)))
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber")).scalar()
    innings = F.transform(
        F.sequence(F.lit(1), "_last"),
        lambda i: F.concat(F.lit("<td>"), F.when(F.col("l_linenumber") == i, shown).otherwise("&nbsp;"), F.lit("</td>")),
    )
    name = F.concat(F.lit('<tr><td class="left">'), F.col("l_partkey").cast("string"), F.lit("</td>"))
    printed = rows.withColumn("_last", last).withColumn("row", F.concat(name, figures, F.array_join(innings, ""), F.lit("</tr>")))
    docs = lineups.nested(printed, ["l_orderkey"], [*views.LINE_ORDER, "l_linestatus", "row"])

    def side(status: str) -> Column:
        mine = F.filter("entries", lambda e: e["l_linestatus"] == status)
        return F.concat(
            F.lit('<table class="batter">'), F.array_join(F.transform(mine, lambda e: e["row"]), ""), F.lit("</table>")
        )

    page = docs.select("l_orderkey", F.concat(side("F"), side("O")).alias("html"))
    # Slots and plays both read the rows, so the pages are taken apart once.
    box = materialized(pages.box_rows(page, ["l_orderkey"]), "box-rows")
    plays = pages.box_plays(box, ["l_orderkey"])
    return plays.groupBy("l_orderkey", "name", "inning_no", F.right("inning", F.lit(1)).alias("half"), "result").agg(
        F.count(F.lit(1)).alias("n")
    )
