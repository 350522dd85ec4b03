"""Tables inside HTML pages, read with built-in text functions.

Input is a frame of pages with an `html` column; one page is one row, so all
of this is narrow until rows are pivoted or nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions import text
from scorebook.functions.rates import share_column
from scorebook.operators.lineups import SLOTS, first_k_distinct, running_slot
from scorebook.operators.summary import pivot_shares
from scorebook.session import materialized

# Cell positions of the season tables.
BATTER_CELLS_WITH_HAND = {
    "ab": 4, "h": 6, "doubles": 7, "triples": 8, "hr": 9, "tb": 10, "sb": 12, "bb": 16, "hbp": 18, "sf": 15,
}
BATTER_CELLS_PLAIN = {
    "ab": 3, "h": 5, "doubles": 6, "triples": 7, "hr": 8, "tb": 9, "bb": 15, "hbp": 17, "sf": 14,
}
PITCHER_CELLS = {"g": 2, "h": 15, "hr": 16, "so": 20, "era": 25}
BOX_FIRST_RESULT = 9


def all_matches(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def plain(col: Column) -> Column:
    """Text of an HTML fragment: tags out, common entities decoded, ends trimmed."""
    bare = F.regexp_replace(col, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def elements(pages: DataFrame, tag: str, keys=("page_id",), html: str = "html") -> DataFrame:
    """One row per element of a tag: page keys, position, attributes, inner HTML."""
    pattern = rf"(?s)<{tag}(?=[\s>])([^>]*)>(.*?)</{tag}>"
    both = F.arrays_zip(
        all_matches(F.col(html), pattern, 1).alias("attributes"),
        all_matches(F.col(html), pattern, 2).alias("inner"),
    )
    return pages.select(*keys, F.posexplode(both).alias("pos", "_e")).select(*keys, "pos", "_e.*")


def attribute(col: Column, name: str) -> Column:
    """Value of a quoted attribute, null when the element lacks it."""
    return F.nullif(F.regexp_extract(col, rf'(?:^|\s){name}="([^"]*)"', 1), F.lit(""))


def attribute_map(col: Column) -> Column:
    """Quoted attributes as a map; the first of a repeated name counts."""
    names = all_matches(col, r'([A-Za-z-]+)="[^"]*"')
    values = all_matches(col, r'[A-Za-z-]+="([^"]*)"')
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    firsts = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(firsts)


def cells_raw(col: Column, tag: str = "td") -> Column:
    """What the cells of a row or table hold, in order."""
    return all_matches(col, rf"(?s)<{tag}(?=[\s>])[^>]*>(.*?)</{tag}>")


def cells(col: Column, tag: str = "td") -> Column:
    """Texts of the cells of a row or table, in order."""
    return F.transform(cells_raw(col, tag), plain)


def stat_rows(pages: DataFrame, keys, row_class: str = "ststats", min_cells: int = 0) -> DataFrame:
    """Table rows of a class as cell arrays; rows with too few cells are left out."""
    rows = elements(pages, "tr", keys)
    marked = F.array_contains(F.split(F.coalesce(attribute(F.col("attributes"), "class"), F.lit("")), r"\s+"), row_class)
    return (
        rows.filter(marked)
        .select(*keys, "pos", cells(F.col("inner")).alias("cells"))
        .filter(F.size("cells") >= min_cells)
    )


def batters_with_hand(pages: DataFrame, keys=("team",)) -> DataFrame:
    """Batter rows of the layout with a hand mark; numbers are read leniently."""
    rows = stat_rows(pages, keys, "ststats", 20)
    return (
        rows.select(
            *keys,
            text.clean_name(F.get("cells", F.lit(1))).alias("name"),
            text.decode_hand(F.get("cells", F.lit(0))).alias("hand"),
            *[text.lenient_int(F.get("cells", F.lit(i))).alias(c) for c, i in BATTER_CELLS_WITH_HAND.items()],
        )
        .filter(F.col("name") != "計")
    )


def batters_plain(pages: DataFrame, keys=("team",), table_class: str = "tablefix2") -> DataFrame:
    """Batter rows of the layout without hand; a row with any unreadable number is dropped."""
    pattern = rf'(?s)<table[^>]*class="[^"]*\b{table_class}\b[^"]*"[^>]*>(.*?)</table>'
    table = F.regexp_extract("html", pattern, 1)
    body = F.regexp_extract(table, r"(?s)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = elements(pages.select(*keys, body.alias("html")), "tr", keys)
    parsed = rows.select(*keys, cells(F.col("inner")).alias("cells")).select(
        *keys,
        text.clean_name(F.get("cells", F.lit(0)), "　*+").alias("name"),
        *[text.strict_int(F.get("cells", F.lit(i))).alias(c) for c, i in BATTER_CELLS_PLAIN.items()],
    )
    return parsed.dropna(subset=list(BATTER_CELLS_PLAIN))


def pitcher_counts(pages: DataFrame, keys=("team",)) -> DataFrame:
    """Pitcher counting rows; every value stays text, a dash as ERA becomes the sentinel."""
    rows = stat_rows(pages, keys, "ststats", 26)

    def cell(i: int) -> Column:
        return F.get("cells", F.lit(i))

    return rows.select(
        *keys,
        text.clean_name(cell(1), "　").alias("name"),
        cell(2).alias("g"),
        F.concat(cell(13), cell(14)).alias("ip"),
        *[cell(PITCHER_CELLS[c]).alias(c) for c in ("h", "hr", "so")],
        text.sentinel(cell(25)).alias("era"),
    )


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)


def header_map(table_html: Column) -> Column:
    """Header text to cell text, by position; headers without a cell are left out."""
    heads, values = cells(table_html, "th"), cells(table_html, "td")
    pairs = F.transform(heads, lambda h, i: F.struct(h.alias("k"), F.get(values, i).alias("v")))
    firsts = F.filter(
        pairs, lambda p, i: (F.array_position(heads, p["k"]) == i + 1) & p["v"].isNotNull()
    )
    return F.map_from_entries(firsts)


def _table_with(html: Column, marker: str) -> Column:
    """First table whose text holds the marker."""
    tables = all_matches(html, r"(?s)(<table(?=[\s>])[^>]*>.*?</table>)")
    return F.get(F.filter(tables, lambda t: t.contains(marker)), F.lit(0))


def pitcher_rates(pages: DataFrame, keys=("team",)) -> DataFrame:
    """Name, throwing hand, ERA, K/9 and HR/9 of pitcher pages.

    A rate without a header is 0.0. Other pages, and pages with a rate that is
    no number, are left out.
    """
    title = title_of(F.col("html"))
    page = (
        pages.filter(title.contains("投手成績"))
        .withColumns(
            {
                "_rates": _table_with(F.col("html"), "通算成績(各種指標)"),
                "_era": _table_with(F.col("html"), "防御率"),
                "name": text.title_name(title),
                "hand": text.throwing_hand(plain(F.col("html"))),
            }
        )
        .filter(F.col("_rates").isNotNull() & F.col("_era").isNotNull())
        .withColumn("_map", header_map(F.col("_rates")))
    )

    def rate(header: str) -> Column:
        value = F.try_element_at("_map", F.lit(header))
        return F.when(value.isNull(), F.lit(0.0)).otherwise(value.try_cast("double"))

    era = text.sentinel(F.get(cells(F.col("_era")), F.lit(0))).try_cast("double")
    return page.select(
        *keys, "name", "hand", era.alias("era"), rate("K/9").alias("k9"), rate("HR/9").alias("hr9")
    ).dropna(subset=["era", "k9", "hr9"])


def pitch_mix(pages: DataFrame, keys=("team",)) -> DataFrame:
    """Long (keys, name, pitch_type, share) rows of pitcher pages."""
    title = title_of(F.col("html"))
    tables = pages.filter(title.contains("投手成績")).select(
        *keys, text.title_name(title).alias("name"), _table_with(F.col("html"), "球種").alias("html")
    )
    rows = elements(tables.filter("html is not null"), "tr", [*keys, "name"]).withColumn(
        "cells", cells(F.col("inner"))
    )
    return (
        rows.filter(F.size("cells") >= 3)
        .select(
            *keys, "name", F.get("cells", F.lit(0)).alias("pitch_type"),
            F.get("cells", F.lit(2)).alias("_share"),
        )
        .filter(~text.is_total_row(F.col("pitch_type")) & (F.col("_share") != "-"))
        .select(*keys, "name", "pitch_type", text.percent(F.col("_share")).alias("share"))
    )


def pitcher_table(pages: DataFrame, keys=("team",), kinds: Sequence[str] | None = None) -> DataFrame:
    """Rates with the pitch mix: one share column per given kind, 0 for pitches a pitcher lacks.

    Without `kinds` the mix is one map column `shares` from pitch type to share,
    so that no list of all types is needed. A pitcher with a share that is no
    number is left out.
    """
    mix = pitch_mix(pages, keys)
    names = [*keys, "name"]
    unreadable = mix.filter("share is null").select(*names).distinct()
    rated = pitcher_rates(pages, keys).join(unreadable, names, "left_anti")
    if kinds is not None:
        wide = pivot_shares(mix, names, "pitch_type", "share", kinds, share_column)
        return rated.join(wide, names, "left").na.fill(0.0, [share_column(k) for k in kinds])
    # One entry per type: a pitcher's types are a handful.
    best = mix.groupBy(*names, "pitch_type").agg(F.max("share").alias("share"))
    maps = best.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("pitch_type", "share"))).alias("shares"))
    none = F.create_map().cast("map<string,double>")
    return rated.join(maps, names, "left").withColumn("shares", F.coalesce("shares", none))


def box_rows(pages: DataFrame, keys=("url",)) -> DataFrame:
    """Batter rows of box scores: team side (0 visitor, 1 home), row position, name, cells."""
    tables = all_matches(
        F.col("html"), r'(?s)<table(?=[\s>])[^>]*class="(?:[^"]*\s)?batter(?:\s[^"]*)?"[^>]*>(.*?)</table>'
    )
    sides = pages.select(*keys, F.posexplode(tables).alias("side", "html"))
    inner = all_matches(F.col("html"), r"(?s)<tr(?=[\s>])[^>]*>(.*?)</tr>")
    rows = sides.select(*keys, "side", F.posexplode(inner).alias("pos", "inner"))
    name = F.regexp_extract("inner", r'(?s)<td[^>]*class="[^"]*\bleft\b[^"]*"[^>]*>(.*?)</td>', 1)
    # Behind an explode a row's cells are found and cleaned once; a filter on them would repeat that work.
    found = F.array(F.struct(name.alias("name"), cells_raw(F.col("inner")).alias("cells")))
    named = rows.select(*keys, "side", "pos", F.inline(found)).filter((F.col("name") != "") & (F.size("cells") >= 10))
    clean = F.array(F.struct(plain(F.col("name")).alias("name"), F.transform("cells", plain).alias("cells")))
    return named.select(*keys, "side", "pos", F.inline(clean)).filter(F.col("name") != "計")


def box_plays(rows: DataFrame, keys=("url",)) -> DataFrame:
    """Plays of box-score rows: slot, name, inning and result per filled result cell."""
    slotted = running_slot(rows, [*keys, "side"], "name", ["pos"], k=SLOTS)
    cell = slotted.select(
        *keys, "side", "pos", "slot", "name",
        F.posexplode(F.slice("cells", BOX_FIRST_RESULT + 1, F.greatest(F.size("cells") - BOX_FIRST_RESULT, F.lit(0)))).alias("_i", "result"),
    )
    return cell.filter(~text.is_placeholder(F.col("result"))).select(
        *keys, "side", "pos", (F.col("_i") + 1).alias("inning_no"), "slot", "name", "result",
        text.inning_label(F.col("_i") + 1, F.col("side") == 0).alias("inning"),
    )


def box_documents(pages: DataFrame) -> DataFrame:
    """Game documents from box-score pages with two teams, keyed by url."""
    page = pages.select(
        "url",
        "html",
        F.transform(all_matches(F.col("html"), r'(?s)<td[^>]*class="[^"]*\bteam\b[^"]*"[^>]*>(.*?)</td>'),
                    lambda t: F.replace(plain(t), F.lit("\xa0"), F.lit(""))).alias("_teams"),
        F.transform(all_matches(F.col("html"), r'(?s)<td[^>]*class="[^"]*\btotalScore\b[^"]*"[^>]*>(.*?)</td>'),
                    plain).alias("_runs"),
    ).filter((F.size("_teams") >= 2) & (F.size("_runs") >= 2))
    # Line-ups and plays both read the rows, so the pages are taken apart once.
    rows = materialized(box_rows(page, ["url"]), "box-rows")
    entries = box_plays(rows).groupBy("url").agg(
        # One box score holds one game's plays.
        F.array_sort(F.collect_list(F.struct("side", "pos", "inning_no", "inning", "slot", "name", "result"))).alias("_p")
    )
    first = first_k_distinct(rows, ["url", "side"], "name", ["pos"], SLOTS)
    ups = first.groupBy("url", "side").agg(
        F.array_sort(F.collect_list(F.struct("slot", "name"))).alias("_n")
    ).groupBy("url").agg(
        F.max(F.when(F.col("side") == 0, F.transform("_n", lambda s: s["name"]))).alias("_visitors"),
        F.max(F.when(F.col("side") == 1, F.transform("_n", lambda s: s["name"]))).alias("_homers"),
    )
    null_plays = F.lit(None).cast("array<struct<lines:array<string>>>")
    null_starters = F.lit(None).cast("array<struct<team:string,name:string>>")
    null_pregame = F.lit(None).cast(
        "struct<lineups:array<struct<team:string,players:array<string>>>,pitchers:array<struct<team:string,name:string>>>"
    )

    def team(i: int) -> Column:
        return F.get("_teams", F.lit(i))

    lineups = F.array(
        F.struct(team(0).alias("team"), F.col("_visitors").alias("players")),
        F.struct(team(1).alias("team"), F.col("_homers").alias("players")),
    )
    opening = F.struct(
        F.lit("試合前").alias("inning"),
        F.struct(lineups.alias("lineups"), null_starters.alias("pitchers")).alias("pregame"),
        null_plays.alias("plays"),
    )
    live = F.transform(
        "_p",
        lambda p: F.struct(
            p["inning"].alias("inning"),
            null_pregame.alias("pregame"),
            F.array(
                F.struct(F.array(F.concat(p["slot"].cast("string"), F.lit("番 "), p["name"]), p["result"]).alias("lines"))
            ).alias("plays"),
        ),
    )
    empty = F.array().cast(
        "array<struct<inning:string,pregame:struct<lineups:array<struct<team:string,players:array<string>>>,"
        "pitchers:array<struct<team:string,name:string>>>,plays:array<struct<lines:array<string>>>>>"
    )
    both = F.col("_visitors").isNotNull() & F.col("_homers").isNotNull()
    scoreboard = F.array(
        *[F.struct(team(i).alias("team"), F.get("_runs", F.lit(i)).alias("R")) for i in (0, 1)]
    )
    return (
        page.drop("html")
        .join(entries, "url", "left")
        .join(ups, "url", "left")
        .select(
            "url",
            scoreboard.alias("scoreboard"),
            F.concat(F.when(both, F.array(opening)).otherwise(empty), F.coalesce(live, empty)).alias("text_live"),
        )
    )
