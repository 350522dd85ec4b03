"""Embedding affinity between hitters and pitchers, and factorisation-machine terms."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.operators.lookup import group_rank
from scorebook.operators.ordering import dense_index
from scorebook.session import materialized

BLOCK_ROWS = 8192
# Scores held at a time inside a task: a strip of hitters against a pitcher block.
STRIP_CELLS = 4_000_000


def dot(left: Column, right: Column, width: int) -> Column:
    """Dot product of two arrays of a known width, unrolled for code generation; another length is an error."""
    total = left[0].cast("double") * right[0].cast("double")
    for i in range(1, width):
        total = total + left[i].cast("double") * right[i].cast("double")
    other = F.raise_error(F.lit(f"a vector has not the length {width}")).cast("double")
    return F.when((F.size(left) != width) | (F.size(right) != width), other).otherwise(total)


def pair_scores(
    pairs: DataFrame, hitters: DataFrame, pitchers: DataFrame, width: int
) -> DataFrame:
    """Scores of given (hitter, pitcher) pairs of different teams.

    `hitters` holds (hitter, h_team, h_vec), `pitchers` (pitcher, p_team, p_vec);
    names without a vector or a team drop out.
    """
    return pairs.join(hitters, "hitter").join(pitchers, "pitcher").filter("h_team <> p_team").select(
        "hitter", "h_team", "pitcher", "p_team", dot(F.col("h_vec"), F.col("p_vec"), width).alias("score")
    )


def _block_top(top: int):
    """Best `top` pitchers of one pitcher block for every hitter of one hitter block.

    Both functions are nested, so tasks get them whole and need no copy of this package.
    """

    def near_top(scores: np.ndarray) -> np.ndarray:
        """Mask of the finite scores that reach the `top` best of their row, or nearly do."""
        keep = np.isfinite(scores)
        if top < scores.shape[1]:
            kth = np.partition(scores, -top, axis=1)[:, -top][:, None]
            keep &= scores >= kth - 1e-9 * np.maximum(1.0, np.abs(kth))
        return keep

    def in_turn(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Dot products added place by place: equal vectors get equal scores in every block."""
        total = left[:, 0] * right[:, 0]
        for i in range(1, left.shape[1]):
            total += left[:, i] * right[:, i]
        return total

    def best(hit: pd.DataFrame, pit: pd.DataFrame) -> pd.DataFrame:
        names = ["hitter", "h_team", "pitcher", "p_team", "score"]
        if hit.empty or pit.empty:
            return pd.DataFrame({n: [] for n in names})
        pit = pit.sort_values("pitcher", kind="stable")
        h_vec = np.stack(hit["h_vec"].to_numpy()).astype("float64")
        p_vec = np.stack(pit["p_vec"].to_numpy()).astype("float64").T
        hitter, h_team = hit["hitter"].to_numpy(), hit["h_team"].to_numpy()
        pitcher, p_team = pit["pitcher"].to_numpy(), pit["p_team"].to_numpy()
        strip, found = max(1, STRIP_CELLS // len(pit)), []
        for start in range(0, len(hit), strip):
            part = slice(start, start + strip)
            scores = h_vec[part] @ p_vec
            scores[h_team[part][:, None] == p_team[None, :]] = -np.inf
            rows, cols = np.nonzero(near_top(scores))
            exact = in_turn(h_vec[part][rows], p_vec.T[cols])
            order = np.lexsort((cols, -exact, rows))  # pitchers are sorted, so columns break ties
            rows, cols, exact = rows[order], cols[order], exact[order]
            first = np.searchsorted(rows, rows)
            best_of = np.arange(len(rows)) - first < top
            rows, cols, exact = rows[best_of], cols[best_of], exact[best_of]
            found.append(
                pd.DataFrame(
                    dict(zip(names, (hitter[part][rows], h_team[part][rows], pitcher[cols], p_team[cols], exact)))
                )
            )
        return pd.concat(found, ignore_index=True)

    return best


def rank(
    hitters: DataFrame, pitchers: DataFrame, top: int, digits: int = 9, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The `top` pitchers of other teams per hitter by embedding affinity; exact.

    Both sides are dealt to blocks by the hash of their unique name, so a block
    stays near `block_rows` whatever the teams look like. Every hitter block
    meets every pitcher block once, as a matrix product inside one task, and
    only `top` rows per hitter leave it; those are merged by a ranked window.
    Exact scores rank, equal ones by pitcher; shown are `digits` digits.
    A `top` at or above the number of pitchers gives the full listing.
    """
    hitters = hitters.filter("h_team is not null and h_vec is not null")
    pitchers = pitchers.filter("p_team is not null and p_vec is not null")
    h_blocks = max(1, -(-hitters.count() // block_rows))
    p_blocks = max(1, -(-pitchers.count() // block_rows))

    def block(name: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks))

    def each(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    left = hitters.withColumn("_hb", block("hitter", h_blocks)).withColumn("_pb", each(p_blocks))
    right = pitchers.withColumn("_pb", block("pitcher", p_blocks)).withColumn("_hb", each(h_blocks))
    fields = [hitters.schema["hitter"], hitters.schema["h_team"], pitchers.schema["pitcher"], pitchers.schema["p_team"]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double"
    found = (
        left.groupBy("_hb", "_pb")
        .cogroup(right.groupBy("_hb", "_pb"))
        .applyInPandas(_block_top(top), schema)
    )
    ranked = group_rank(found, ["hitter"], [F.desc("score"), "pitcher"], top)
    return ranked.withColumn("score", F.round("score", digits))


def _by_norm(side: DataFrame, name: str, vec: str, block_rows: int) -> DataFrame:
    """Adds the vector's length and its block; blocks follow each other by falling length."""
    norm = F.sqrt(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))
    placed = dense_index(side.select(name, (-norm).alias("_down")), ["_down", name], "_place")
    blocks = placed.select(
        F.col(name).alias("_name"), (-F.col("_down")).alias("_norm"), F.floor(F.col("_place") / block_rows).alias("_block")
    )
    return side.join(blocks, F.col(name) == F.col("_name")).drop("_name")


def _rounds(blocks: int) -> list[tuple[int, int]]:
    """Ranges of pitcher blocks that are met together, each twice as long as the one before."""
    out, start, size = [], 0, 1
    while start < blocks:
        out.append((start, min(blocks, start + size)))
        start, size = start + size, size * 2
    return out


class Ranking(NamedTuple):
    """The ranked pairs, and per round how many hitters could meet its pitcher blocks and how many had to."""

    ranked: DataFrame
    rounds: DataFrame


def rank_by_bounds(
    hitters: DataFrame, pitchers: DataFrame, top: int, digits: int = 9, block_rows: int = BLOCK_ROWS
) -> Ranking:
    """As `rank`, without meeting pitchers whose vectors are too short to matter.

    A score is at most the product of both lengths. Pitcher blocks are met in
    falling order of length, in rounds of doubling size; after each round a
    hitter's `top`-th score so far says which later blocks can still hold a
    better one, and it is sent to these only. Where no block can, it is done.
    Equal scores may still change places by name, so a block is skipped only if
    it cannot reach the `top`-th score either. The result equals `rank`'s.
    """
    hitters = hitters.filter("h_team is not null and h_vec is not null")
    pitchers = pitchers.filter("p_team is not null and p_vec is not null")
    spark = hitters.sparkSession
    left = materialized(_by_norm(hitters, "hitter", "h_vec", block_rows), "hitters")
    right = materialized(_by_norm(pitchers, "pitcher", "p_vec", block_rows), "pitchers")
    # One row per block of pitchers: its longest vector.
    lengths = right.groupBy(F.col("_block").alias("_pb")).agg(F.max("_norm").alias("_longest"))
    blocks = (right.agg(F.max("_block")).first()[0] or 0) + 1
    fields = [hitters.schema["hitter"], hitters.schema["h_team"], pitchers.schema["pitcher"], pitchers.schema["p_team"]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double"
    n_hitters, best, reported = left.count(), None, []
    for n, (start, end) in enumerate(_rounds(blocks)):
        asking = left.withColumn("_kth", F.lit(float("-inf")))
        if best is not None:
            kth = best.groupBy("hitter").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).select(
                F.col("hitter").alias("_name"), F.when(F.col("_n") >= top, F.col("_least")).otherwise(F.lit(float("-inf"))).alias("_kth")
            )
            asking = left.join(kth, F.col("hitter") == F.col("_name"), "left").drop("_name").withColumn(
                "_kth", F.coalesce("_kth", F.lit(float("-inf")))
            )
        here = lengths.where((F.col("_pb") >= start) & (F.col("_pb") < end))
        ahead = here.agg(F.sort_array(F.collect_list(F.struct("_pb", "_longest")))).scalar()  # one entry per block of the round
        # Rounding in the product of lengths must not cost a pair: the bound gets a margin.
        can = F.filter("_ahead", lambda b: F.col("_norm") * b["_longest"] * (1 + 1e-9) + 1e-12 >= F.col("_kth"))
        sent = asking.withColumn("_ahead", ahead).withColumn("_pb", F.explode(F.transform(can, lambda b: b["_pb"])))
        sent = materialized(sent.drop("_ahead", "_kth"), "asking")
        reported.append((n, end - start, n_hitters, sent.count()))
        pairs = sent.select(F.col("_block").alias("_hb"), "_pb").distinct()
        facing = right.withColumn("_pb", F.col("_block")).join(pairs, "_pb").drop("_block", "_norm")
        found = (
            sent.withColumnRenamed("_block", "_hb").drop("_norm").groupBy("_hb", "_pb")
            .cogroup(facing.groupBy("_hb", "_pb"))
            .applyInPandas(_block_top(top), schema)
        )
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = materialized(group_rank(found, ["hitter"], [F.desc("score"), "pitcher"], top), "best")
    report = spark.createDataFrame(
        [(n, size, total * size, met, total * size - met) for n, size, total, met in reported],
        "round int, blocks int, possible long, met long, skipped long",
    )
    return Ranking(best.withColumn("score", F.round("score", digits)), report)


def affinity_report(ranked: DataFrame) -> DataFrame:
    """Report lines (hitter, line_no, line): a heading, one line per pitcher, a rule."""
    body = F.struct(
        F.col("rank").alias("line_no"),
        F.format_string(
            "  vs %-12s (%-2s) | Score: %10.6f", F.col("pitcher").cast("string"), F.col("p_team").cast("string"), "score"
        ).alias("line"),
    )
    head = F.struct(
        F.lit(0).alias("line_no"),
        F.format_string("【打者】%s (%s)", F.col("hitter").cast("string"), F.col("h_team").cast("string")).alias("line"),
    )
    rule = F.struct(F.lit(2**31 - 1).alias("line_no"), F.lit("-" * 60).alias("line"))
    # The first-ranked row of a hitter also brings the heading and the rule.
    lines = F.when(F.col("rank") == 1, F.array(head, body, rule)).otherwise(F.array(body))
    return ranked.select("hitter", F.explode(lines).alias("_l")).select("hitter", "_l.line_no", "_l.line")


def fm_interaction(df: DataFrame, group: Sequence[str], vec: str, out: str = "interaction") -> DataFrame:
    """Pairwise interaction of each group's vectors: half of |sum v|² minus sum |v|².

    No pair is formed: one partial vector sum per group and map task suffices.
    """
    dense = df.select(*group, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    metrics = Summarizer.metrics("sum", "normL2").summary(F.col("_v")).alias("_m")
    square_sum = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x)
    return (
        dense.groupBy(*group)
        .agg(metrics)
        .select(
            *group,
            (
                (square_sum(vector_to_array("_m.sum")) - square_sum(vector_to_array("_m.normL2"))) / 2
            ).alias(out),
        )
    )
