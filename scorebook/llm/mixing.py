"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the sources in code point order, null last, weigh `weights` in turn and
share the size of the whole corpus; no target exceeds `most` times the size of
its source, and what is cut off goes to the others by weight.

Blocks: a hash of id and text deals the documents of a source into blocks of
about `block_words` words, so a source with a third of all rows is many blocks.
A source's quota is exact: every block once per full pass, then blocks in order
up to the target, the last one cut between two documents.

Tree: the quotas of all sources are split in two, again and again, until every
leaf is an output shard. The left half of a node is a draw without replacement
from all its block draws, so the split of every source follows the multivariate
hypergeometric distribution. Ranks come from prefix counts of the hashes, never
from one task that sorts a whole node. A shard then takes its quota of each
source from that source's permuted draws, disjoint from all other shards, and
orders its documents by hash.

Only DataFrame operations: the sizes are computed in one scan, and the tree works
on rows per block.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source of its own, the last one; rows without an id or that repeat
are dealt by their text like all others; a corpus without a word has targets 0.
Extra columns are ignored by `find` and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorebook.session import materialized

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 1 << 16
BLOCK_DOCS = 1 << 12
SHARD_BLOCKS = 256
SEED = 1
WORD = r"[^\x20\x09-\x0D]+"
MADE = ("mix_shard", "mix_pass", "mix_order")


def _size(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    """A hexadecimal hash of the id and the text of a row."""
    parts = F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(F.concat_ws("|", *parts))


def _number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: Sequence[int], most: int, block_words: int, block_docs: int) -> DataFrame:
    """Per source: its size, target, number of blocks, full passes, and the words of the last pass."""
    s = sized.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_n"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("_w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", (F.col("_total") * most).cast("double"))
    s = s.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())))
    every, by_cap = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("_r")
    all_ = F.sum("_total").over(every).cast("double")
    below = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_share", (all_ - below) / rest)
    fits = F.when(F.col("_share") * F.col("_w") <= F.col("_cap"), F.col("_share"))
    share = F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_target", F.least(share * F.col("_w"), F.col("_cap")))
    passes = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_total") / block_words), F.ceil(F.col("_n") / block_docs)).cast("long")
    return s.select(
        "_source", F.col("_total").alias("_source_size"), "_target", blocks.alias("_blocks"), passes.alias("_passes"),
        (F.col("_target") - passes * F.col("_total")).alias("_rest"),
    )


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its block and the words of its block up to its middle."""
    a, b = sized.alias("a"), sources.alias("b")
    joined = a.join(b, F.col("a._source").eqNullSafe(F.col("b._source"))).select(
        "a.*", "_source_size", "_target", F.pmod(_number(F.col("_hash")), F.col("_blocks")).alias("_block")
    )
    before = Window.partitionBy("_source", "_block").orderBy("_hash", "_size").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("_middle", F.sum("_size").over(before) - F.col("_size") / 2)


def ranked(rows: DataFrame, group: Sequence[str], key: Column) -> DataFrame:
    """The rows with `_rank`, their place (from 0) in the order of a hash within their group.

    Rows are numbered within the leading bits of the hash, and these by their
    counts, so no group is sorted in one task.
    """
    keyed = rows.withColumn("_key", key).withColumn("_lead", F.shiftrightunsigned("_key", 52))
    counts = keyed.groupBy(*group, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_lead").alias("_gl"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_lead") == F.col("_gl")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_lead").orderBy("_key", *[c for c in rows.columns if c not in group])
    joined = keyed.join(counts, same).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    return joined.select(*rows.columns, "_rank")


def block_draws(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The block draws of the mix: source, pass, block, and for the last block of a source the words to take."""
    sizes = docs.groupBy("_source", "_block").agg(F.sum("_size").alias("_words"))
    upto = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    a = sizes.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0))).alias("a")
    b = sources.alias("b")
    joined = a.join(b, F.col("a._source").eqNullSafe(F.col("b._source"))).select("a.*", "_passes", "_rest")
    whole = joined.where("_passes > 0").select(
        "_source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_passes"))).alias("_pass"), "_block",
        F.lit(None).cast("double").alias("_upto"),
    )
    ends = F.col("_before") + F.col("_words")
    last = joined.where("_before < _rest AND _words > 0").select(
        "_source", (F.col("_passes") + 1).alias("_pass"), "_block",
        F.when(ends > F.col("_rest"), F.col("_rest") - F.col("_before")).alias("_upto"),
    )
    return whole.unionByName(last)


def shard_quotas(draws: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, source, quota): the splitting tree over the block quotas of the sources."""
    quotas = materialized(draws.groupBy("_source").agg(F.count(F.lit(1)).alias("_quota")).withColumn("_node", F.lit(0).cast("long")), "quotas")
    total, shards = quotas.agg(F.sum("_quota")).first()[0] or 0, 1
    while total > shards * shard_blocks:
        shards *= 2
        slots = quotas.select("_node", "_source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_quota"))).alias("_slot"))
        drawn = ranked(slots, ["_node"], F.xxhash64(F.lit(seed), F.lit(shards), "_node", "_source", "_slot"))
        half = quotas.groupBy(F.col("_node").alias("_of")).agg(F.ceil(F.sum("_quota") / 2).alias("_left"))
        side = drawn.join(half, F.col("_node") == F.col("_of")).select(
            "_source", (F.col("_node") * 2 + (F.col("_rank") >= F.col("_left")).cast("long")).alias("_node")
        )
        quotas = materialized(side.groupBy("_node", "_source").agg(F.count(F.lit(1)).alias("_quota")), "quotas")
    return quotas.withColumnRenamed("_node", "_shard")


def dealt(draws: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """Every block draw with its shard: the draws of a source are permuted and handed out quota by quota."""
    upto = Window.partitionBy("_source").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_quota").over(upto), F.lit(0))
    slots = quotas.withColumn("_first", first).select(
        F.col("_source").alias("_of"), "_shard",
        F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_quota") - 1)).alias("_slot"),
    )
    permuted = ranked(draws, ["_source"], F.xxhash64(F.lit(seed), F.lit("draw"), "_source", "_pass", "_block"))
    met = (F.col("_rank") == F.col("_slot")) & F.col("_source").eqNullSafe(F.col("_of"))
    return permuted.join(slots, met).select("_source", "_pass", "_block", "_upto", "_shard")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), _size(text_col).alias("_size"),
        _hash(id_col, text_col, seed).alias("_hash"),
    )


def _plan(
    sized: DataFrame, weights: Sequence[int], most: int, block_words: int, block_docs: int, shard_blocks: int, seed: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with their targets, placed documents, and block draws with their shards; written tables."""
    sources = materialized(targets(sized, weights, most, block_words, block_docs), "sources")
    docs = materialized(placed(sized, sources), "placed")
    draws = materialized(block_draws(docs, sources), "draws")
    return sources, docs, materialized(dealt(draws, shard_quotas(draws, shard_blocks, seed), seed), "dealt")


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS,
    shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> DataFrame:
    """Per document: id, size, source_size, target of its source, and the words the mix takes, repeats counted."""
    sized = materialized(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    _, placed_, draws = _plan(sized, weights, most, block_words, block_docs, shard_blocks, seed)
    per_block = draws.groupBy(F.col("_source").alias("_of"), F.col("_block").alias("_in")).agg(
        F.count(F.when(F.col("_upto").isNull(), 1)).alias("_whole"), F.max("_upto").alias("_upto")
    )
    met = placed_.join(per_block, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_in")), "left")
    times = F.coalesce("_whole", F.lit(0)) + F.when(F.col("_middle") <= F.col("_upto"), 1).otherwise(0)
    return met.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * times).cast("long").alias("taken"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS,
    shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> DataFrame:
    """The mix itself: every taken copy with all its columns, its `mix_shard`, its `mix_pass` and `mix_order` within the shard.

    Columns of the documents with these three names are replaced. Rows come partitioned by shard and sorted by order, ready to be written.
    """
    sized = materialized(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    sources, _, draws = _plan(sized, weights, most, block_words, block_docs, shard_blocks, seed)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in MADE]).alias("_doc"), F.col(source_col).alias("_source"),
        _size(text_col).alias("_size"), _hash(id_col, text_col, seed).alias("_hash"),
    )
    a, b = placed(whole, sources).alias("a"), draws.alias("b")
    met = F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a._block") == F.col("b._block"))
    taken = F.col("_upto").isNull() | (F.col("_middle") <= F.col("_upto"))
    copies = a.join(b, met).where(taken & (F.col("_size") > 0)).select(
        "_doc.*", F.col("_shard").alias("mix_shard"), F.col("_pass").alias("mix_pass"),
        F.xxhash64(F.lit(seed), F.col("_pass"), F.col("_hash")).alias("mix_order"),
    )
    return copies.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
