"""Play results to counting-stat deltas.

A rule set is ordered data: the first rule with a marker inside the text wins.
Three sets exist: `literal` (marker characters anywhere in the text),
`notation` (the shorthand of the logs, where 二 and 三 name bases and doubles
and triples are the full-width digits) and `longform` (spelled-out words).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("ab", "h", "tb", "hr", "bb", "hbp", "sf")


@dataclass(frozen=True)
class Rule:
    label: str
    markers: tuple[str, ...]
    ab: int = 0
    h: int = 0
    tb: int = 0
    hr: int = 0
    bb: int = 0
    hbp: int = 0
    sf: int = 0


# Markers, their order and their counts.
RULES: dict[str, tuple[Rule, ...]] = {
    "literal": (
        Rule("H2", ("二",), ab=1, h=1, tb=2),
        Rule("H3", ("三",), ab=1, h=1, tb=3),
        Rule("HR", ("本",), ab=1, h=1, tb=4, hr=1),
        Rule("H1", ("安",), ab=1, h=1, tb=1),
        Rule("BB", ("四球", "敬遠"), bb=1),
        Rule("HBP", ("死球",), hbp=1),
        Rule("SF", ("犠飛",), sf=1),
        Rule("OUT", ("ゴ", "飛", "振", "直", "斜", "失", "野選"), ab=1),
    ),
    "notation": (
        Rule("HR", ("本",), ab=1, h=1, tb=4, hr=1),
        Rule("H1", ("安",), ab=1, h=1, tb=1),
        Rule("H2", ("２",), ab=1, h=1, tb=2),
        Rule("H3", ("３",), ab=1, h=1, tb=3),
        Rule("BB", ("四球", "敬遠"), bb=1),
        Rule("HBP", ("死球",), hbp=1),
        Rule("SF", ("犠",), sf=1),
        Rule("SAC", ("ギ",)),
        Rule("OUT", ("ゴ", "飛", "振", "直", "斜", "失", "野選", "邪", "併"), ab=1),
    ),
    "longform": (
        Rule("BB", ("フォアボール", "四球", "敬遠"), bb=1),
        Rule("HBP", ("デッドボール", "死球"), hbp=1),
        Rule("HR", ("ホームラン", "本塁打"), ab=1, h=1, tb=4),
        Rule("H1", ("ヒット", "安打"), ab=1, h=1, tb=1),
        Rule("SF", ("犠牲フライ",), sf=1),
        Rule("OUT", ("",), ab=1),
    ),
}
NO_PLAY = Rule("NONE", ())


def _chain(text: Column, rules: str, value) -> Column:
    chain = None
    for rule in RULES[rules]:
        hit = text.contains(rule.markers[0])
        for marker in rule.markers[1:]:
            hit = hit | text.contains(marker)
        chain = F.when(hit, value(rule)) if chain is None else chain.when(hit, value(rule))
    return chain.otherwise(value(NO_PLAY))


def play_class(text: Column, rules: str = "literal") -> Column:
    """Label of the first rule that matches, `NONE` when no rule does."""
    return _chain(text, rules, lambda r: F.lit(r.label))


def deltas(text: Column, rules: str = "literal") -> Column:
    """Struct of counting-stat changes (ab, h, tb, hr, bb, hbp, sf) of one play."""
    def counts(rule: Rule) -> Column:
        return F.expr("named_struct(" + ", ".join(f"'{m}', {getattr(rule, m)}" for m in MEASURES) + ")")

    return _chain(text, rules, counts)
