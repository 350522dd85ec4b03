"""The elements of a page as a tree, from its stream of tags.

A page is cut into tags; prefix sums over opening and closing tags of one name
pair them, and prefix sums over the pairs give every element its depth. An
element inside one of the same name ends with its own closing tag, so a table
in a cell does not end the table around it.

Comments and declarations are no tags, and what stands in a script or a style
is no markup. Elements that are never closed (a lone paragraph) or never have
an end (a line break) hold nothing; a closing tag without an opening one counts
for nothing. Where pairs cross, an element belongs to the last one opened at
the depth above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_RAW = r"<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
_TOKEN = rf"<!--.*?-->|{_RAW}|</?[a-z][^>]*>|<![^>]*>"
_PIECE = rf"(?is)(.*?)({_TOKEN})"


def _extract(col: Column, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(_PIECE), F.lit(group))


def tokens(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(keys, pos, step, name, tag, start, end): the tags of every page in order.

    `step` is 1 for an opening tag, -1 for a closing one, 0 for an element that
    holds no others; `start` and `end` are the characters where the tag begins
    and ends, from 0. A script or a style is one tag with all it holds.
    """
    pieces = F.arrays_zip(_extract(F.col(html), 1).alias("before"), _extract(F.col(html), 2).alias("tag"))
    at = pages.select(*keys, F.posexplode(pieces).alias("pos", "_p")).select(*keys, "pos", "_p.before", "_p.tag")
    upto = Window.partitionBy(*keys).orderBy("pos")
    name = F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][^\s/>]*)", 1))
    ends = F.sum(F.length("before") + F.length("tag")).over(upto)
    leaf = name.isin(*VOID, "script", "style") | F.col("tag").endswith("/>")
    step = F.when(F.col("tag").startswith("</"), F.lit(-1)).when(leaf, F.lit(0)).otherwise(F.lit(1))
    placed = at.withColumns({"name": name, "step": step, "end": ends})
    return placed.where("name <> ''").select(
        *keys, "pos", "step", "name", "tag", (F.col("end") - F.length("tag")).alias("start"), "end"
    )


def _paired(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds to every opening tag the place of its closing tag (null without one), and to every closing one whether it has an opening."""
    same_name = Window.partitionBy(*keys, "name").orderBy("pos")
    # The level an opening tag leads to is the level its closing tag comes from.
    level = F.sum("step").over(same_name) + F.when(F.col("step") < 0, F.lit(1)).otherwise(F.lit(0))
    leveled = stream.withColumn("_level", F.when(F.col("step") != 0, level))
    turns = Window.partitionBy(*keys, "name", "_level").orderBy("pos")
    following = {c: F.lead(c).over(turns) for c in ("step", "pos", "start", "end")}
    closed = (F.col("step") == 1) & (F.col("_next_step") == -1)
    return leveled.withColumns({f"_next_{c}": f for c, f in following.items()} | {"_last_step": F.lag("step").over(turns)}).withColumns(
        {"close": F.when(closed, F.col("_next_pos")), "close_start": F.when(closed, F.col("_next_start")),
         "_closes": (F.col("step") == -1) & (F.col("_last_step") == 1)}
    )


def tree(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(keys, pos, name, tag, depth, parent, close, inner_start, inner_end): one row per element of a page.

    `depth` counts the closed elements around it, `parent` is the `pos` of the
    innermost of them; `close` is the place of its closing tag. The characters from
    `inner_start` up to `inner_end` are what it holds, null where it is not closed.
    """
    paired = _paired(tokens(pages, keys, html), keys)
    inside = F.when(F.col("close").isNotNull(), F.lit(1)).when(F.col("_closes"), F.lit(-1)).otherwise(F.lit(0))
    upto = Window.partitionBy(*keys).orderBy("pos")
    opened = F.when(F.col("close").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    found = paired.withColumn("depth", (F.sum(inside).over(upto) - opened).cast("int")).where("step >= 0")
    # An element stands among those it could hold: the last closed one before it at the depth above is its parent.
    holds = F.struct(F.col("depth").alias("among"), F.lit(True).alias("holds"))
    held = F.struct((F.col("depth") - 1).alias("among"), F.lit(False).alias("holds"))
    both = found.withColumn("_r", F.explode(F.when(F.col("close").isNotNull(), F.array(holds, held)).otherwise(F.array(held))))
    before = Window.partitionBy(*keys, "_r.among").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("_r.holds"), F.col("pos")), ignorenulls=True).over(before)
    return both.withColumn("parent", holder).where("NOT _r.holds").select(
        *keys, "pos", "name", "tag", "depth", "parent", "close", F.when(F.col("close").isNotNull(), F.col("end")).alias("inner_start"),
        F.col("close_start").alias("inner_end"),
    )


def elements(pages: DataFrame, tag: str, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(keys, pos, depth, parent, attributes, inner) of the closed elements of a tag; the keys name one page each."""
    found = tree(pages, keys, html).where((F.col("name") == tag.lower()) & F.col("close").isNotNull())
    inner = F.substring(F.col(html), F.col("inner_start").cast("int") + 1, (F.col("inner_end") - F.col("inner_start")).cast("int"))
    attributes = F.regexp_extract("tag", r"(?s)^<[^\s/>]+([^>]*)>$", 1)
    return found.join(pages.select(*keys, html), list(keys)).select(
        *keys, "pos", "depth", "parent", attributes.alias("attributes"), inner.alias("inner")
    )


def table_cells(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(keys, table, row, cell, inner): the cells of every table, inner tables' cells under their own table only.

    `table`, `row` and `cell` are the places of the opening tags.
    """
    all_ = tree(pages, keys, html)
    names = ("table", "tr", "td", "th", "thead", "tbody", "tfoot")
    parts = all_.where(F.col("name").isin(*names))
    # A row or a section belongs to the table opened last at a lower depth that is still open: its nearest table around.
    tables = parts.where("name = 'table'").select(*keys, F.col("pos").alias("table"), F.col("close").alias("_until"), F.col("depth").alias("_td"))
    rows = parts.where("name = 'tr'").select(*keys, F.col("pos").alias("row"), F.col("depth").alias("_rd"))
    around = rows.join(tables, list(keys)).where("row > table AND row < _until")
    nearest = around.groupBy(*keys, "row").agg(F.max_by("table", "_td").alias("table"))
    cells = parts.where("name IN ('td', 'th') AND close IS NOT NULL").select(
        *keys, F.col("pos").alias("cell"), F.col("parent").alias("row"), "inner_start", "inner_end"
    )
    inner = F.substring(F.col(html), F.col("inner_start").cast("int") + 1, (F.col("inner_end") - F.col("inner_start")).cast("int"))
    placed = cells.join(nearest, [*keys, "row"])
    return placed.join(pages.select(*keys, html), list(keys)).select(*keys, "table", "row", "cell", inner.alias("inner"))
