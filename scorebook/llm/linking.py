"""From buckets of similar items to components, without comparing all pairs of a bucket."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.components import components
from scorebook.llm.minhash import SKETCH_BITS
from scorebook.session import materialized

BITS = 1 << 26


LEADS = 2


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The keys that two or more different nodes hold; summed before the shuffle."""
    groups = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return groups.where("low < high").select("key")


def star_pairs(members: DataFrame) -> DataFrame:
    """Every node of a bucket with the leads of the bucket, as pairs (a, b), a below b.

    The leads are drawn by hash, other ones for every key, so that a node which
    sits in many buckets meets many different partners.
    """
    drawn = [F.min_by("node", F.xxhash64("key", F.lit(i), "node")).alias(f"_{i}") for i in range(LEADS)]
    leads = members.groupBy("key").agg(*drawn).select("key", F.array_distinct(F.array(*[f"_{i}" for i in range(LEADS)])).alias("leads"))
    # Members may come out of an explode, which Spark sizes by the rows before it: their leads are not broadcast.
    met = members.join(leads.hint("merge"), "key").select("node", F.explode("leads").alias("lead")).where("node != lead")
    return met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A set of hashes as a bitmap of fixed size (8 MB), for skipping rows before a shuffle.

    It never drops a member. With more members than bits it lets more others
    through, up to all of them, and the exact join behind it does the work.
    """
    place = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1
    rows = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for the hashes that may be members."""
    place = hashes.astype(np.uint64, copy=False) & np.uint64(BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def possible(rows: DataFrame, hash_: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """The rows whose hash may be among the wanted ones: for skipping rows with long texts before a join shuffles them."""
    context = rows.sparkSession.sparkContext
    bits = context.broadcast(bitmap(wanted.select(wanted_hash.alias("_hash")), "_hash"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy()
            out = batch.select(range(batch.num_columns - 1)).filter(pa.array(contains(bits.value, hashes.view(np.uint64))))
            if out.num_rows:
                yield out

    return rows.withColumn("_hash", hash_).mapInArrow(run, rows.schema)


def most_differing(percent: int, sigmas: float, size: int = SKETCH_BITS) -> int:
    """Bits in which the sketches of two sets at this similarity differ at most, but for `sigmas` deviations."""
    share = (1 - percent / 100) / 2
    return math.ceil(size * share + sigmas * math.sqrt(size * share * (1 - share)))


def _differing(column: str, size: int) -> Column:
    """Bits in which a column of two rows x and y differs; null where a row has none."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.{column}")[i].bitwiseXOR(F.col(f"y.{column}")[i])) for i in range(size // 64)])


def open_pairs(
    members: DataFrame, found: DataFrame, sketched: Callable[[DataFrame], DataFrame], percent: int, sigmas: float,
    size: int = SKETCH_BITS, odd_size: int = 0,
) -> DataFrame:
    """Pairs that share a bucket, differ in component, and are close enough in size and sketch to be linked.

    A pair that shares several buckets comes out of the one with the smallest key only.
    """
    known = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x < _y")
    known = materialized(known.join(mixed.select("key"), "key"), "mixed")
    keys = known.groupBy("node").agg(F.collect_list("key").alias("keys"))  # as many as there are bands at most
    nodes = keys.join(sketched(keys.select("node")), "node")
    known = materialized(known.join(nodes, "node"), "open")
    x, y = known.alias("x"), known.alias("y")
    close = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    if odd_size:  # linked sets differ in (100 - percent) / (100 + percent) of their elements at most, odd sketches in no more bits
        close &= _differing("odd", odd_size) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    close &= F.coalesce(_differing("bits", size) <= most_differing(percent, sigmas, size), F.lit(True))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
    other = F.col("x.component") != F.col("y.component")
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return x.join(y, meet & other & close & once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def linked(
    members: DataFrame, confirmed: Callable[[DataFrame], DataFrame], sketched: Callable[[DataFrame], DataFrame],
    percent: int, sigmas: float, size: int = SKETCH_BITS, odd_size: int = 0,
) -> DataFrame:
    """(node, component) of every node with a confirmed link.

    `members` (key, node) are the nodes of shared buckets; `confirmed` keeps the
    true links of a table of pairs (a, b), `sketched` gives the set sizes (without
    repeats) and sketches (node, n, bits) of a table of nodes, `size` bits each. With `odd_size` it also gives odd
    sketches (odd) of that many bits, which never rule out a link, and bits may be null. Every node is first compared with the leads
    of its buckets, a fixed number of candidates per member. A large group of
    near copies becomes one component by that even if most of its pairs are no
    links. Then the pairs whose components still differ are compared, all of them
    whose sketches do not rule out a link by `sigmas` deviations.
    """
    stars = materialized(star_pairs(members), "stars")
    links = materialized(confirmed(stars), "links")
    found = materialized(components(links), "components")
    rest = open_pairs(members, found, sketched, percent, sigmas, size, odd_size).join(stars, ["a", "b"], "left_anti")
    more = materialized(confirmed(rest), "links")
    if not more.take(1):
        return found
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stands for all links so far
    return components(known.unionByName(more))
