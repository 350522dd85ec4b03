"""Words looked up inside texts by a trie whose edges are rows.

A node is a beginning of a word; a text goes on to the next depth only from a
node it reached, by an equi-join. So a text costs as many rows as it shares
beginnings with words, however many words there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.functions.classify import MEASURES, NO_PLAY, RULES
from scorebook.session import materialized


def nodes(words: DataFrame, scope: Sequence[str], word: str, depths: Sequence[int] | None = None) -> DataFrame:
    """(scope, depth, prefix, whole): the beginnings of the words, at every depth or at the given ones; whole ones are words."""
    known = words.select(*scope, F.col(word).alias("_w")).where("_w IS NOT NULL").distinct()
    ends = F.sequence(F.lit(1), F.length("_w")) if depths is None else F.filter(
        F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.length("_w")
    )
    cut = known.where("_w <> ''").select(*scope, "_w", F.explode(ends).alias("depth"))
    prefix = F.substring("_w", F.lit(1), F.col("depth"))
    return cut.groupBy(*scope, "depth", prefix.alias("prefix")).agg(F.bool_or(F.length("_w") == F.col("depth")).alias("whole"))


def hits(texts: DataFrame, words: DataFrame, scope: Sequence[str], text: str, word: str, depths: Sequence[int] | None = None) -> DataFrame:
    """The columns of `texts` with every word (column `_word`) that its text starts with.

    `scope` are columns of both sides that must be equal. One join per depth; a
    text without a node at a depth is not looked at further down.
    """
    trie = materialized(nodes(words, scope, word, depths), "trie")
    found, now = [], texts
    levels = sorted(r[0] for r in trie.select("depth").distinct().collect())  # as many as the longest word has letters
    for depth in levels:
        step = trie.where(F.col("depth") == depth).select(*[F.col(s).alias(f"_{s}") for s in scope], "prefix", "whole")
        same = [texts_scope == F.col(f"_{s}") for s, texts_scope in ((s, F.col(s)) for s in scope)]
        met = reduce(lambda a, b: a & b, same, F.substring(F.col(text), 1, depth) == F.col("prefix"))
        now = materialized(now.select(*texts.columns).join(step, met & (F.length(text) >= depth)).drop(*[f"_{s}" for s in scope]), "reached")
        found.append(now.where("whole").select(*texts.columns, F.col("prefix").alias("_word")))
    none = texts.where(F.lit(False)).withColumn("_word", F.lit(""))
    return reduce(DataFrame.unionByName, found, none)


def rule_rows(spark: SparkSession, rules: str) -> DataFrame:
    """A rule set as a table: (rank, label, marker, measures), one row per marker."""
    rows = [(i, r.label, m, *[getattr(r, c) for c in MEASURES]) for i, r in enumerate(RULES[rules]) for m in r.markers]
    return spark.createDataFrame(rows, "rank int, label string, marker string, " + ", ".join(f"{m} int" for m in MEASURES))


def classified(plays: DataFrame, rules: DataFrame, text: str = "result") -> DataFrame:
    """Plays with `cls` and the measures of the first rule, by rank, of which a marker stands in the text.

    `rules` is a table as `rule_rows` makes it, with any markers; an empty marker
    stands in every text. Texts are looked up once each, from every place in them.
    """
    distinct = plays.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    places = distinct.withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)))))
    rest = places.withColumn("_rest", F.substring("_text", F.col("_at"), F.length("_text")))
    met = hits(rest, rules, [], "_rest", "marker").select("_text", F.col("_word").alias("marker")).distinct()
    everywhere = distinct.withColumn("marker", F.lit("")).join(rules.where("marker = ''").select("marker").distinct(), "marker")
    ranked = met.unionByName(everywhere.select("_text", "marker")).join(rules, "marker").groupBy("_text").agg(
        F.min(F.struct("rank", "label", *MEASURES)).alias("_rule")
    )
    joined = plays.join(ranked, F.col(text) == F.col("_text"), "left").drop("_text")

    def of(name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"_rule.{name}"), default).alias(name)

    return joined.select(
        *plays.columns, F.coalesce("_rule.label", F.lit(NO_PLAY.label)).alias("cls"), *[of(m, F.lit(0)) for m in MEASURES]
    )


def unique_prefix_match(short: DataFrame, full: DataFrame, scope: str, short_name: str, full_name: str) -> DataFrame:
    """(scope, short name, full name) of the short names that exactly one full name of their scope starts with.

    The trie has the lengths that are asked for; a full name goes on to a longer
    one only where a short name goes on with it.
    """
    asked = short.select(scope, F.col(short_name).alias("_short")).distinct()
    known = full.select(scope, F.col(full_name).alias("_full")).distinct()
    depths = sorted(r[0] for r in asked.select(F.length("_short").alias("n")).where("n > 0").distinct().collect())  # lengths of names
    found = hits(known, asked, [scope], "_full", "_short", depths)
    alone = found.groupBy(scope, "_word").agg(F.count(F.lit(1)).alias("_n"), F.min("_full").alias("_full")).where("_n = 1")
    return alone.select(scope, F.col("_word").alias(short_name), F.col("_full").alias(full_name))
