"""Game addresses: finding them in text, and which of them are still to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.text import game_id_from_url
from scorebook.sources.games import has_plays

# Fixed value: game pages are named by league letters and digits.
GAME_PAGE = r"(?:cl|pl|il)\d+\.html"


def extract_urls(lines: DataFrame, col: str, pattern: str, base: str = "", group: int = 0) -> DataFrame:
    """Distinct sorted matches of `pattern` in a text column, each after `base`."""
    found = F.explode(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group)))
    return (
        lines.select(found.alias("_m"))
        .select(F.concat(F.lit(base), F.col("_m")).alias("url"))
        .distinct()
        .orderBy("url")
    )


def pending(urls: DataFrame, stored: DataFrame) -> DataFrame:
    """Addresses without a stored document that holds plays."""
    done = has_plays(stored).select("game_id").distinct()
    asked = urls.withColumn("game_id", game_id_from_url(F.col("url")))
    return asked.join(done, "game_id", "left_anti")


def page_grid(teams: DataFrame, template: str, cols: list[str], numbers: Column | None = None) -> DataFrame:
    """One address per team row and number; numbers are 00, 0, 1 … 99 unless given."""
    if numbers is None:
        tail = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda n: n.cast("string"))
        numbers = F.concat(F.array(F.lit("00"), F.lit("0")), tail)
    grid = teams.withColumn("number", F.explode(numbers))
    return grid.withColumn("url", F.format_string(template, *cols, "number"))
