"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard similarity, components.

1. One map turns every document into the size and a 128-bit fingerprint of its
   shingle set and its band keys. Equal sets collapse to their smallest id, so
   any number of exact copies goes on as one node.
2. A bucket (equal band key) is reduced before the shuffle to a few leads drawn
   by hash. In buckets with two or more nodes every node is compared with the
   leads: a few candidates per node, not the square of the bucket.
3. Candidates are confirmed on full shingle sets, and confirmed links merged
   into components.
4. Nodes that share a bucket but not yet a component are compared pair by pair,
   unless their 2048-bit sketches differ by SIGMAS deviations more than a link's
   would; a group of near copies is one component by then, so these are few. No
   partner is capped, so every pair that meets in a bucket and could still
   change a component is tested.

With 40 bands of 8 rows a pair at the default similarity of 0.85 is missed with
probability 3e-6, by its sketches with 3e-7, and a pair at 0.3 meets with probability 0.003.

Defined results: a document without words has an empty set and is linked with
nothing (its component is its own id). Rows that share an id count as one
document. A row without an id is linked with nothing, its component is null and
it is kept. Extra columns are ignored by `find` and kept by `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm import hashing as H
from scorebook.llm import linking, minhash, passages
from scorebook.session import materialized

WORDS = 5
PERCENT = 85
BANDS, ROWS = 40, 8
SIGMAS = 5.0
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column."""
    data, offsets = H.utf8(column)
    for _, _, d, o in H.blocks(data, offsets):
        hashes, rows = H.word_hashes(d, o, H.WHITESPACE, fold=True)
        runs = H.window_hashes(hashes, words)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield H.window_hashes(hashes[a:b], b - a) ^ _SHORT
            else:
                yield runs[:0]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows, dtype=np.int64, casting="no") if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: id, set size n, set fingerprint (hi, lo) and band keys."""

    none = np.zeros(0, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                p = minhash.set_print(s)
                n.append(len(s))
                hi.append(p[0])
                lo.append(p[1])
                keys.append(H.as_long(minhash.band_keys(minhash.signature(s, bands * rows), bands, rows)) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, hi, lo)), _lists(keys)], ["id", "n", "hi", "lo", "bands"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, hi long, lo long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [H.as_long(s) for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, shingles array<long>")


def _sketched(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, bits) of the nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [minhash.sketch(s.values.to_numpy().view(np.uint64)) for s in batch.column(1)]
            n = batch.column(1).value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, _lists(bits)], ["node", "n", "bits"])

    some = sets.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").where("size(shingles) > 0")
    return some.mapInArrow(run, "node long, n long, bits array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least `percent` of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    sizes = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b").where(sizes[0] * 100 >= sizes[1] * percent)
        .withColumn("_shared", shared)
        .where(F.col("_shared") * 100 >= (F.size("x") + F.size("y") - F.col("_shared")) * percent)
        .select("a", "b").distinct()
    )


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(node, component) of every node that has a link."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    members = materialized(keyed.join(linking.shared_keys(keyed), "key"), "members")
    wanted = members.select(F.col("node").alias(id_col)).distinct()
    sets = materialized(_sets(docs.select(id_col, text_col).join(wanted, id_col), id_col, text_col, words), "sets")
    return linking.linked(members, lambda pairs: confirmed(pairs, sets, percent), lambda nodes: _sketched(sets, nodes), percent, SIGMAS)


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id it is linked with, directly or not) and kept."""
    drawn = materialized(sketches(docs, id_col, text_col, words, bands, rows), "sketches")
    nodes = materialized(
        drawn.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo", "n").agg(
            F.min("id").alias("node"), F.any_value("bands").alias("bands")
        ), "nodes",
    )
    of_set = (
        nodes.select("hi", "lo", "n", "node")
        .join(_links(docs, nodes.select("node", "bands"), id_col, text_col, words, percent), "node", "left")
        .select("hi", "lo", "n", F.coalesce("component", "node").alias("component"))
    )
    named = drawn.select("id", "n", "hi", "lo").join(of_set, ["hi", "lo", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with all its columns: the row of the smallest id.

    Different texts under one id count for themselves; of repeated rows of one
    text and id one stays, the same on every run. Rows without an id all stay.
    """

    def kept(rows: DataFrame, key: str) -> DataFrame:
        chosen = find(rows, key, text_col, **options).where("kept").select(key).distinct()
        one = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
        rank = "_rank"
        while rank in rows.columns:
            rank += "_"
        return rows.join(chosen, key, "left_semi").withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).drop(rank)

    named = passages.by_text(docs.where(F.col(id_col).isNotNull()), id_col, text_col, kept)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
