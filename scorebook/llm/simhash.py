"""Near-duplicates by SimHash: 64-bit fingerprints linked at a few differing bits, by multi-index hashing.

1. Every shingle is hashed by XXH64 with seed 42. A bit of the fingerprint is 1
   where more than half of the hashes have it. Equal
   fingerprints go on as one node, so any number of copies costs one row.
2. A fingerprint is cut into two segments of 32 bits. Two fingerprints that
   differ in at most three bits differ in at most one bit of one segment, so a
   table of exact segments is probed with the ball of radius one around each
   segment. Of a pair that differs in one bit of a segment the side that holds a
   1 there probes, so a node asks with as many keys as it has ones.
3. Whole distances are verified. First every member of a bucket is compared with
   a few leads drawn by hash; groups of near copies become components by that
   without their pairs. Then members that still differ in component meet. In a
   bucket of over CROWDED nodes they meet by byte: the other segment differs in
   three bits at most, so one of its four bytes is equal.
4. Links are merged into components by the distributed union-find.

Distances over 3 are refused: two segments with balls of radius one are exact up to 3.

Defined results: a null, empty or blank text has no shingles and fingerprint
zero, and is linked like any other. A text of fewer than `words` words is one
shingle, its whole sequence. Repeated shingles count as often as they stand, so
ties (half of the hashes) give 0. Very long texts are read whole; one text's
hashes are in one task. Repeated rows and repeated ids each get a row. A row
without an id is linked like any other; it never names a component, and its
component is null where no row with an id is reached. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scorebook.llm import hashing as H
from scorebook.llm.components import components
from scorebook.llm.linking import star_pairs
from scorebook.session import materialized

WORDS = 3
SEED = 42
DISTANCE = 3
CROWDED = 1024
_HALF = 0xFFFFFFFF
_VOTES = 1 << 17  # hashes whose bits are counted at once


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` lower-cased words of a UTF-8 text, repeats included."""
    w = text.lower().split()  # of bytes: A-Z and the white space of ASCII alone
    n = max(len(w) - words + 1, min(len(w), 1))
    runs = zip(*[w[i : len(w) - words + 1 + i] for i in range(words)]) if len(w) >= words else [w] * n
    return np.fromiter((xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64, n)


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For rows of hashes (ends: offsets, one more than rows), the bits that over half of a row's hashes have."""
    votes = np.zeros((len(ends) - 1, 64), np.int64)
    for a in range(0, len(hashes), _VOTES):
        b = min(len(hashes), a + _VOTES)
        bits = np.unpackbits(np.ascontiguousarray(hashes[a:b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, b, side="left")
        rows = np.arange(first, last)
        rows = rows[ends[rows + 1] > ends[rows]]
        votes[rows] += np.add.reduceat(bits, np.maximum(ends[rows] - a, 0), axis=0, dtype=np.int64)
    won = 2 * votes > np.diff(ends)[:, None]
    return np.packbits(won, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in hashed])]).astype(np.int64)
            fps = majority(np.concatenate(hashed), ends) if hashed else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(H.as_long(fps))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def _segment(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(_HALF))


def _key(segment: Column, half: int) -> Column:
    """The segment and its place as one long: a bucket of the table."""
    return F.shiftleft(segment, 1) + half


def tables(nodes: DataFrame) -> DataFrame:
    """(key, node): every node under its two exact segments."""
    keys = F.array(*[_key(_segment(F.col("node"), h), h) for h in (0, 1)])
    return nodes.withColumn("key", F.explode(keys))


def probes(nodes: DataFrame) -> DataFrame:
    """(key, node): the keys at which a node looks: its exact segments, and those with one of its ones taken out."""
    node = F.col("node")
    keys = []
    for half in (0, 1):
        segment = _segment(node, half)
        ones = F.filter(F.expr("transform(sequence(0, 31), i -> shiftleft(1L, i))"), lambda bit: segment.bitwiseAND(bit) != 0)
        keys.append(F.transform(F.concat(F.array(F.lit(0).cast("long")), ones), lambda bit: _key(segment - bit, half)))
    return nodes.withColumn("key", F.explode(F.concat(*keys)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bytes_of_other(node: Column, key: Column) -> Column:
    """(place, value) of the four bytes of the segment that is not the key's."""
    other = F.when(key.bitwiseAND(F.lit(1)) == 0, _segment(node, 1)).otherwise(_segment(node, 0))
    return F.array(*[F.lit(i * 256) + F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)])


def cross_links(nodes: DataFrame, distance: int, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between components, of all pairs within the distance whose components differ; nodes are (node, component)."""
    held, asked = tables(nodes), probes(nodes)
    full = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key", F.lit(True).alias("full"))
    full = materialized(full, "crowded")
    whole = F.array(F.lit(-1).cast("long"))

    def parted(rows: DataFrame) -> DataFrame:
        marked = rows.join(full, "key", "left")
        return marked.withColumn("part", F.explode(F.when(F.col("full"), _bytes_of_other(F.col("node"), F.col("key"))).otherwise(whole)))

    if full.take(1):
        held, asked = parted(held), parted(asked)
    else:
        held, asked = held.withColumn("part", F.lit(-1)), asked.withColumn("part", F.lit(-1))
    x, y = held.alias("x"), asked.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
    close = (F.col("x.component") != F.col("y.component")) & (_distance("x.node", "y.node") <= distance)
    # Spark sizes both sides by the nodes, of which the probes are some thirty times as many rows: neither is broadcast.
    return x.join(y.hint("merge"), meet & close).select(
        F.least("x.component", "y.component").alias("a"), F.greatest("x.component", "y.component").alias("b")
    ).distinct()


def linked(nodes: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(node, component) of every node that has a link; nodes are distinct fingerprints."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one are exact up to a distance of 3")
    stars = star_pairs(tables(nodes)).where(_distance("a", "b") <= distance)
    found = materialized(components(stars), "components")
    named = materialized(
        nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "named"
    )
    more = materialized(cross_links(named, distance, crowded), "links")
    if not more.take(1):
        return found
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(more))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE,
    crowded: int = CROWDED,
) -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits) and component_id, the smallest id reachable."""
    drawn = materialized(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialized(drawn.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least")), "nodes")
    component = F.coalesce("component", "node")
    whole = nodes.join(linked(nodes.select("node"), distance, crowded), "node", "left").select("node", component.alias("component"), "least")
    whole = materialized(whole, "whole")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = whole.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    return drawn.join(of_node, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
