"""Merkle manifest of a dataset: a digest per row, a tree per source, one root, and a proof per row by pointer jumping.

1. A row's leaf is the SHA-256 of its fields, each with its length in bytes.
2. Leaves get their place within their source: rows are range-partitioned and
   sorted by (source, id, leaf), so a place is the position in the partition
   plus the rows of that source in partitions before; no source is one group.
3. Sixteen neighbouring nodes make one parent, level by level, up to the
   source's subroot; the subroots, in the order of their sources, make the root.
   Every level is one group-by on the parent's place, of at most sixteen rows each.
4. Proofs: a node holds its segment, the siblings on both sides on the way to an
   ancestor, and that ancestor. A self-join on the ancestor appends the
   ancestor's segment and takes over its ancestor, which doubles the distance;
   after log2(height) joins every node reaches the root. The jumping runs on the
   inner nodes, one for every fifteen leaves; a leaf's last step is the run that
   holds it, so sixteen leaves share one long segment until each is folded.

Defined results: a null field counts as `-`; an empty text is `0:`. Rows without
an id come first in their source, rows that share an id follow the order of
their leaves; repeated rows are leaves of their own. Rows without a source form
a source of their own, before all others. Very long texts are hashed whole. An
empty table gives an empty result and has no root. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.session import materialized

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN_BITS = 4  # sixteen nodes to a parent
TOP = -1  # the tree over the subroots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: of every field its length in UTF-8 bytes, a colon and the value; `-` for a null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def _numbered(ordered: DataFrame) -> DataFrame:
    """A stored, range-partitioned and sorted table with its partition and the position in it."""
    mid = F.monotonically_increasing_id()
    return ordered.withColumns({"_part": F.spark_partition_id(), "_pos": mid.bitwiseAND(F.lit((1 << 33) - 1))})


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves with the number of their source (tree, in the order of sources, null first) and their place in it (pos).

    The partitions of the sort cut every source into pieces; there are at most
    as many pieces as partitions and sources together, and only these are numbered by windows.
    """
    ordered = materialized(
        _numbered(leaves.repartitionByRange(F.asc_nulls_first("source"), F.asc_nulls_first("id"), "leaf").sortWithinPartitions(
            F.asc_nulls_first("source"), F.asc_nulls_first("id"), "leaf"
        )), "leaves",
    )
    pieces = ordered.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sources = materialized(pieces.groupBy("source").agg(F.sum("_n").alias("size")), "sources")
    trees = _ranked(sources)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    pieces = pieces.join(trees, pieces["source"].eqNullSafe(trees["_source"])).drop("_source")
    at = pieces.select(
        F.col("source").alias("_source"), F.col("_part").alias("_piece"), "tree", "size", (F.col("_before") - F.col("_first")).alias("_shift")
    )
    same = ordered["source"].eqNullSafe(at["_source"]) & (ordered["_part"] == at["_piece"])
    return ordered.join(at, same).withColumn("pos", F.col("_pos") + F.col("_shift")).drop("_source", "_piece", "_shift", "_part", "_pos")


def _ranked(sources: DataFrame) -> DataFrame:
    """(_source, size, tree): sources numbered in their order; partitions are numbered by their counts, as leaves are."""
    ordered = materialized(
        _numbered(sources.repartitionByRange(F.asc_nulls_first("source")).sortWithinPartitions(F.asc_nulls_first("source"))), "ranked"
    )
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(counts.select("_part", before.alias("_before")), "_part").select(
        F.col("source").alias("_source"), "size", (F.col("_pos") + F.col("_before")).alias("tree")
    )


def height(size: int) -> int:
    """Levels above the leaves of a tree of that many."""
    levels = 0
    while size > 1:
        size, levels = (size + (1 << RUN_BITS) - 1) >> RUN_BITS, levels + 1
    return levels


def _parents(nodes: DataFrame) -> DataFrame:
    """The runs of a level's nodes (tree, size, pos, node): one row per parent with its digest and its members in order."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node")))  # sixteen at most
    runs = nodes.groupBy("tree", F.shiftright("pos", RUN_BITS).alias("parent")).agg(
        F.max("size").alias("size"), members.alias("members")
    )
    joined = F.array_join(F.transform("members", lambda m: m["node"]), "")
    return runs.withColumns({
        "node": F.sha2(joined, 256), "pos": F.col("parent"), "size": F.shiftright(F.col("size") + ((1 << RUN_BITS) - 1), RUN_BITS)
    }).drop("parent")


def _climb(nodes: DataFrame, first_level: int, sizes: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels above the given nodes, and the subroots of all their trees.

    Every level is (tree, level, pos, node, size, members); a tree is over where its level has one node.
    """
    levels, now, tops = [], nodes.select("tree", "pos", "node", "size"), []
    for level in range(first_level + 1, first_level + 1 + height(sizes)):
        tops.append(now.where("size = 1").select("tree", "node", F.lit(level - 1).alias("level")))
        above = materialized(_parents(now.where("size > 1")).withColumn("level", F.lit(level)), "level")
        levels.append(above)
        now = above.select("tree", "pos", "node", "size")
    tops.append(now.where("size = 1").select("tree", "node", F.lit(first_level + height(sizes)).alias("level")))
    return levels, reduce(DataFrame.unionByName, tops)


def _segments(runs: DataFrame) -> DataFrame:
    """(tree, level, pos, up_tree, up_level, up_pos, segment) of the members of runs: one step up with the siblings on both sides."""
    nodes = F.transform("members", lambda m: m["node"])
    side = lambda start, n: F.array_join(F.slice(nodes, start, n), "")
    at = runs.select("*", F.posexplode("members").alias("_i", "_m"))
    segment = F.struct(
        side(F.lit(1), F.col("_i")).alias("left"), side(F.col("_i") + 2, F.greatest(F.size("members") - F.col("_i") - 1, F.lit(0))).alias("right")
    )
    return at.select(
        "tree", (F.col("level") - 1).alias("level"), F.col("_m.pos").alias("pos"), F.col("tree").alias("up_tree"),
        F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), F.array(segment).alias("segment"),
    )


def jumped(steps: DataFrame, levels: int) -> DataFrame:
    """The steps of all nodes lengthened to the root: every join doubles the distance to the ancestor.

    Ancestors that far up are few: those of a source's tree stand more than `distance` levels up in it.
    """
    now, distance = materialized(steps, "steps"), 1
    ancestor = [F.col(c).alias(f"_{c}") for c in ("tree", "level", "pos")]
    while distance < levels:
        above = now.where((F.col("tree") == TOP) | (F.col("level") > distance)).select(
            *ancestor, F.col("up_tree").alias("_t"), F.col("up_level").alias("_l"), F.col("up_pos").alias("_p"), F.col("segment").alias("_s")
        )
        met = (F.col("up_tree") == F.col("_tree")) & (F.col("up_level") == F.col("_level")) & (F.col("up_pos") == F.col("_pos"))
        now = materialized(
            now.join(above, met, "left").select(
                "tree", "level", "pos", F.coalesce("_t", "up_tree").alias("up_tree"), F.coalesce("_l", "up_level").alias("up_level"),
                F.coalesce("_p", "up_pos").alias("up_pos"),
                F.when(F.col("_s").isNull(), F.col("segment")).otherwise(F.concat("segment", "_s")).alias("segment"),
            ), "steps",
        )
        distance *= 2
    return now


def folded(leaf: Column, segment: Column) -> Column:
    """The digest at the top of a segment, from the leaf and its siblings."""
    return F.aggregate(segment, leaf, lambda at, s: digest(s["left"], at, s["right"]))


def proofs(leaves: DataFrame) -> DataFrame:
    """Leaves (id, source, leaf and any others) with subroot, root and segment.

    `segment` holds, from the leaf up to the root, the digests left and right of the path.
    """
    at = materialized(placed(leaves), "placed")
    most = at.agg(F.max("size"), F.max("tree")).first()
    if most[0] is None:
        kind = "array<struct<left:string,right:string>>"
        return leaves.select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(kind).alias("segment"))
    extra = [c for c in leaves.columns if c not in ("source", "leaf")]
    in_sources, subroots = _climb(at.withColumnRenamed("leaf", "node"), 0, most[0])
    subroots = materialized(subroots, "subroots")
    n_sources = most[1] + 1
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "node", F.lit(n_sources).cast("long").alias("size"))
    in_top, roots = _climb(top, 0, n_sources)
    root = F.lit(roots.first()["node"])
    # A subroot is a node of its source's tree; its first step leads into the tree above.
    steps = [_segments(level) for level in in_sources[1:] + in_top[1:]]
    if in_top:
        ground = _segments(in_top[0]).drop("tree", "level").withColumnRenamed("pos", "tree")
        steps.append(subroots.select("tree", "level").join(ground, "tree").withColumn("pos", F.lit(0).cast("long")))
    paths = None
    if steps:
        columns = ["tree", "level", "pos", "up_tree", "up_level", "up_pos", "segment"]
        paths = jumped(reduce(DataFrame.unionByName, [s.select(*columns) for s in steps]), len(in_sources) + len(in_top))
    return _leaf_proofs(at, extra, subroots.select("tree", F.col("node").alias("subroot")), root, paths)


def _leaf_proofs(at: DataFrame, extra: list[str], subroots: DataFrame, root: Column, paths: DataFrame | None) -> DataFrame:
    """A run of leaves takes its parent's path once; every leaf puts its own siblings before it."""
    rows = F.sort_array(F.collect_list(F.struct("pos", F.col("leaf").alias("node"), F.struct(*extra, "source").alias("row"))))  # sixteen at most
    runs = at.groupBy("tree", F.shiftright("pos", RUN_BITS).alias("up")).agg(F.max("size").alias("size"), rows.alias("members"))
    runs = runs.join(subroots, "tree")
    # The parent of a run is the node above it; a lone leaf is a subroot itself.
    level = F.when(F.col("size") > 1, F.lit(1)).otherwise(F.lit(0))
    if paths is None:
        runs = runs.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    else:
        up = paths.select(F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("pos").alias("_p"), F.col("segment").alias("path"))
        met = (F.col("tree") == F.col("_t")) & (level == F.col("_l")) & (F.col("up") == F.col("_p"))
        runs = runs.join(up, met, "left")
    nodes = F.transform("members", lambda m: m["node"])
    at_leaf = runs.withColumn("_nodes", nodes).select("*", F.posexplode("members").alias("_i", "_m"))
    own = F.struct(
        F.array_join(F.slice("_nodes", F.lit(1), F.col("_i")), "").alias("left"),
        F.array_join(F.slice("_nodes", F.col("_i") + 2, F.size("_nodes") - F.col("_i") - 1), "").alias("right"),
    )
    none = F.array().cast("array<struct<left:string,right:string>>")
    segment = F.concat(F.when(F.col("size") > 1, F.array(own)).otherwise(none), F.coalesce("path", none))
    return at_leaf.select(
        *[F.col(f"_m.row.{c}").alias(c) for c in extra], F.col("_m.row.source").alias("source"), F.col("_m.node").alias("leaf"),
        "subroot", root.alias("root"), segment.alias("segment"),
    )


def lowered(field: Column) -> Column:
    return F.translate(field, UPPER, LOWER)


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and the root folded from the row after tampering with its check.

    Rows whose id's CRC-32 is divisible by 5 are tampered with: the A-Z of their text are lower-cased.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(tampered & F.col("text").rlike("[A-Z]"), leaf_digest([lowered(f) if c == "text" else f for c, f in zip(FIELDS, fields)]))
    leaves = docs.select(F.col("doc_id").alias("id"), "source", leaf_digest(fields).alias("leaf"), changed.alias("changed"))
    siblings = F.array_join(F.transform("segment", lambda s: F.concat(s["left"], s["right"])), "")
    proved = proofs(leaves).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("segment")))
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
