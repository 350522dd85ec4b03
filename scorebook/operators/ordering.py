"""Dense numbering and hold-out splitting without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.session import checkpointed

# Leading hex digits of a digest that name its bucket: 16**5 buckets.
_BUCKET_DIGITS = 5


def dense_index(df: DataFrame, order: Sequence[str], out: str = "id") -> DataFrame:
    """Number rows 0, 1, 2, … in the order of `order`, which must be unique.

    Rows are range-partitioned, sorted and checkpointed, so that the position
    inside a partition is fixed. A row's number is that position plus the rows
    in the partitions before it; only one count per partition is broadcast.
    """
    fixed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = fixed.withColumn("_mid", F.monotonically_increasing_id()).withColumns(
        {
            "_part": F.shiftright("_mid", 33),
            "_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    # One row per partition: the window below never sees more than that.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_pos") + F.col("_before")).alias(out)
    )


def with_holdout(
    df: DataFrame,
    keys: Sequence[str],
    fraction: float = 0.2,
    seed: int = 42,
    out: str = "is_valid",
) -> DataFrame:
    """Flag the first ceil(fraction * n) rows in md5(seed:key) order.

    The cut is found in two jobs that never sort the whole table: the rows are
    counted per digest prefix (at most 16**5 counts), then the digests of the
    one prefix that holds the cut are ranked. One row of each job comes back, so
    the flag itself is a plain comparison wherever the result is used. Rows that
    share a key stay on the same side.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    digests = df.select(digest.alias("_d"))
    prefix = F.substring("_d", 1, _BUCKET_DIGITS)
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        digests.groupBy(prefix.alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cum", F.sum("_n").over(upto))
    )
    want = F.ceil(F.lit(str(fraction)).cast("decimal(10,8)") * F.max("_cum").over(Window.partitionBy()))
    cut = (
        running.withColumn("_want", want)
        .filter("_cum >= _want and _cum - _n < _want")
        .select("_b", F.expr("_want - (_cum - _n)").alias("_left"))
        .first()
    )
    if cut is None:  # no rows, or a fraction of nothing
        return df.withColumn(out, F.lit(False))
    within = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        digests.filter(prefix == cut["_b"])
        .groupBy("_d")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_d", F.sum("_n").over(within).alias("_cum"))
        .filter(F.col("_cum") >= cut["_left"])
        .agg(F.min("_d").alias("_d"))
        .first()
    )
    return df.withColumn(out, digest <= F.lit(last["_d"]))
