"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents.

Defined results: a null or empty text has no words, so quality rules reject it.
Null ids, sources, languages and sizes are kept as they are; a null source is a
source of its own in the mix. Rows that share an id, and rows without one, are
judged by their own text; of rows that repeat an id and a text near-duplicates
keep one, and rows without an id all stay there. Of equal lines and near copies
the smallest id stays. Very long texts are read whole. Extra columns pass
through, whatever their names. Empty tables give empty results.

ORACLE_SQL is None: fuzzy lines are linked by similarity over all pairs, which
SQL can't do on whole tables; tests/llm holds the stages against plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.llm import decontaminate, lines, mixing, neardup, repetition
from scorebook.llm.registry import ship, table
from scorebook.session import materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the repetition rules; the others go."""
    ship(spark)
    return repetition.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere first; those that lose every line go, n_chars follows the text."""
    ship(spark)
    cleaned = lines.clean(docs, drop_emptied=True)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates at a similarity of 0.8; 56 bands of 7 miss a pair there with 2e-6."""
    ship(spark)
    return neardup.representatives(docs, percent=80, bands=56, rows=7).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontaminate.passing(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every taken copy with its shard, pass and order."""
    ship(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
