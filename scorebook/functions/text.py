"""Text cleansing and parsing as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result cells that carry no play.
PLACEHOLDERS = ("", "……", " ", "---", "\xa0")
# Names of total rows.
TOTAL_NAMES = ("計", "合計")
# Full-width digits and their ASCII forms.
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
# Team spelling to normalise.
TEAM_SPELLINGS = {"ＤｅＮＡ": "DeNA"}
# Team name to letter code.
TEAM_CODES = {
    "巨人": "G", "読売": "G", "G": "G",
    "阪神": "T", "T": "T",
    "DeNA": "DB", "ＤｅＮＡ": "DB", "横浜": "DB", "DB": "DB", "YB": "DB",
    "広島": "C", "C": "C",
    "ヤクルト": "S", "S": "S",
    "中日": "D", "D": "D",
    "ソフトバンク": "H", "H": "H",
    "ロッテ": "M", "M": "M",
    "日本ハム": "F", "F": "F",
    "西武": "L", "L": "L",
    "楽天": "E", "E": "E",
    "オリックス": "B", "B": "B",
}
# Hand texts and their codes.
BATTING_HANDS = {"右打": 0, "左打": 1, "両打": 2}
THROWING_HANDS = {"右投": 0, "左投": 1}
# Fixed value: earned-run average of a pitcher without a figure.
ERA_SENTINEL = "9.99"
UNKNOWN_NAME = "不明"


def literal_map(pairs: Mapping) -> Column:
    """A fixed small mapping as a map literal, so a lookup needs no join."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def map_codes(col: Column, codes: Mapping[str, str] = TEAM_CODES) -> Column:
    """Trimmed value mapped to its code; values without a code pass through."""
    key = F.trim(col)
    return F.coalesce(literal_map(codes)[key], key)


def encode(col: Column, codes: Mapping[str, int]) -> Column:
    """Category to integer; unknown and null become 0."""
    return F.coalesce(literal_map(codes)[col], F.lit(0))


def encode_if_text(df, name: str, codes: Mapping[str, int]) -> Column:
    """Encode a textual column; a column that is numeric already is only null-filled."""
    if df.schema[name].dataType.typeName() in ("string", "varchar", "char"):
        return encode(F.col(name), codes)
    return F.coalesce(F.col(name).cast("int"), F.lit(0))


def normalize_team(col: Column, spellings: Mapping[str, str] = TEAM_SPELLINGS) -> Column:
    for wrong, right in spellings.items():
        col = F.replace(col, F.lit(wrong), F.lit(right))
    return col


def decode_hand(mark: Column) -> Column:
    """Star = left, plus = both, anything else = right; the star is tested first."""
    return (
        F.when(mark.contains("*"), F.lit("左打"))
        .when(mark.contains("+"), F.lit("両打"))
        .otherwise(F.lit("右打"))
    )


def clean_name(col: Column, drop: str = "　 *+") -> Column:
    """Remove every character of `drop`."""
    return F.translate(col, drop, "")


def lenient_int(col: Column) -> Column:
    """Comma-grouped integer; an empty text or a dash counts as 0."""
    text = F.replace(F.trim(col), F.lit(","), F.lit(""))
    return F.when(text.isin("", "-"), F.lit(0)).otherwise(text.try_cast("int"))


def strict_int(col: Column) -> Column:
    """Integer or null; callers drop the rows with nulls."""
    return F.trim(col).try_cast("int")


def fullwidth_int(col: Column) -> Column:
    """Integer written with ASCII or full-width digits; null when it is neither."""
    return F.translate(F.trim(col), FULLWIDTH_DIGITS, ASCII_DIGITS).try_cast("int")


def percent(col: Column) -> Column:
    """`12.3%` to 12.3; a dash becomes null."""
    return F.replace(F.trim(col), F.lit("%"), F.lit("")).try_cast("double")


def sentinel(col: Column, marker: str = "-", value: str = ERA_SENTINEL) -> Column:
    return F.when(col == marker, F.lit(value)).otherwise(col)


def batting_slot(col: Column) -> Column:
    """Slot number of a `<n>番 <name>` line, null when the line has another form."""
    digits = F.regexp_extract(col, r"(?U)^(\d+)番\s+.+", 1)
    return fullwidth_int(F.nullif(digits, F.lit("")))


def batting_name(col: Column) -> Column:
    """Name of a `<n>番 <name>` line, null when the line has another form."""
    return F.nullif(F.regexp_extract(col, r"(?U)^\d+番\s+(.+)", 1), F.lit(""))


def second_token(col: Column) -> Column:
    """Second space-separated token, null when there is none."""
    return F.get(F.split(col, " "), F.lit(1))


def inning_label(number: Column, top: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("回"), F.when(top, F.lit("表")).otherwise(F.lit("裏")))


def inning_number(label: Column) -> Column:
    return fullwidth_int(F.nullif(F.regexp_extract(label, r"(?U)^(\d+)回", 1), F.lit("")))


def inning_is_top(label: Column) -> Column:
    """True for a top half, false for a bottom half, null outside play."""
    return F.when(label.contains("表"), F.lit(True)).when(label.contains("裏"), F.lit(False))


def is_placeholder(col: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    return col.isin(*placeholders)


def is_total_row(col: Column) -> Column:
    return col.isin(*TOTAL_NAMES)


def game_id_from_url(url: Column) -> Column:
    """Last path segment without its `.html` ending."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.html$", "")


def url_to_file_name(url: Column) -> Column:
    return F.concat(game_id_from_url(url), F.lit(".json"))


def game_date(game_id: Column) -> Column:
    """`cl2025032802` holds the date 2025-03-28 after its league letters."""
    digits = F.nullif(F.regexp_extract(game_id, r"(\d{8})", 1), F.lit(""))
    return F.to_date(digits, "yyyyMMdd")


def title_name(title: Column, pattern: str = r"投手成績 \d+ (.*?) -") -> Column:
    found = F.trim(F.regexp_extract(title, pattern, 1))
    return F.when(found == "", F.lit(UNKNOWN_NAME)).otherwise(found)


def throwing_hand(page_text: Column) -> Column:
    """First throwing hand found in a text, tested right before left."""
    return (
        F.when(page_text.contains("右投"), F.lit("右投"))
        .when(page_text.contains("左投"), F.lit("左投"))
        .otherwise(F.lit(UNKNOWN_NAME))
    )
