"""Schemas of the input tables and documents, and canonical column names."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCOREBOARD = T.ArrayType(_struct(team=S, R=S))
LINEUPS = T.ArrayType(_struct(team=S, players=T.ArrayType(S)))
STARTERS = T.ArrayType(_struct(team=S, name=S))
PLAYS = T.ArrayType(_struct(lines=T.ArrayType(S)))
LIVE = T.ArrayType(
    _struct(inning=S, pregame=_struct(lineups=LINEUPS, pitchers=STARTERS), plays=PLAYS)
)
# One game document. `pitchers` is declared although many files lack it: an
# inferred schema would drop the field and its readers would fail.
GAME = _struct(url=S, scoreboard=SCOREBOARD, text_live=LIVE)

# Header names of the season tables and their internal names.
CANONICAL = {
    "Hand": "hand", "AB": "ab", "H": "h", "2B": "doubles", "3B": "triples", "HR": "hr",
    "TB": "tb", "SB": "sb", "BB": "bb", "HBP": "hbp", "SF": "sf", "ERA": "era",
    "K/9": "k9", "HR/9": "hr9", "G": "g", "IP": "ip", "SO": "so",
    "AVG": "avg", "SLG": "slg", "IsoD": "isod",
}
TEXT_COLUMNS = ("team", "name", "hand")
