"""Point-in-time totals that are kept, and mended where stored games change.

Two tables hold what `running.exclusive_totals` computes. `steps` has one row per
key and game with the game's own sums and the totals inside its chunk before
the game; its parts are the chunks. `offsets` has one row per key and chunk with
the chunk's sums and the totals of the chunks before it. A corrected game
changes the rows of its keys in its own chunk, and moves the offsets of these
keys in later chunks by the difference; no other chunk's steps are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.sources.generations import PART, Generations, Manifest

_START = "0"  # the part of what was known at the start; sorts before every chunk


class PointInTime:
    """Totals of `measures` (whole numbers) per key before each requested game, in tables under a path.

    `order` is the string column that orders games; its first `chunk_chars`
    characters name the chunk and hold letters, digits, `-` and `_` only. `label`
    names a column that goes with the order key, one value for each.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], order: str, measures: Sequence[str], chunk_chars: int, label: str
    ):
        self.keys, self.order, self.measures, self.label = list(keys), order, list(measures), label
        self.chunk_chars = chunk_chars
        self.steps = Generations(spark, f"{path}/steps")
        self.offsets = Generations(spark, f"{path}/offsets")

    def _part(self) -> Column:
        return F.concat(F.lit("c_"), F.substring(self.order, 1, self.chunk_chars))

    def _sums(self) -> list[Column]:
        return [F.sum(m).cast("long").alias(m) for m in self.measures]

    def _summed(self, requests: DataFrame | None, changes: DataFrame) -> DataFrame:
        """One row per key and game: its sums, and whether it is asked for."""
        at = [*self.keys, self.order, self.label]
        rows = changes.select(*at, *[F.col(m).cast("long").alias(m) for m in self.measures], F.lit(False).alias("asked"))
        if requests is not None:
            rows = rows.unionByName(requests.select(*at, *[F.lit(0).cast("long").alias(m) for m in self.measures], F.lit(True).alias("asked")))
        known = rows.where(F.col(self.order).isNotNull()).withColumn(PART, self._part())
        return known.groupBy(*self.keys, PART, self.order, self.label).agg(F.bool_or("asked").alias("asked"), *self._sums())

    def _within(self, summed: DataFrame) -> DataFrame:
        """Adds the totals inside the chunk before each game."""
        inside = Window.partitionBy(*self.keys, PART).orderBy(self.order).rowsBetween(Window.unboundedPreceding, -1)
        return summed.withColumns({f"in_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in self.measures})

    def _before(self, chunk_sums: DataFrame) -> DataFrame:
        """Adds the totals of the chunks before each chunk."""
        earlier = Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        return chunk_sums.withColumns({f"before_{m}": F.coalesce(F.sum(m).over(earlier), F.lit(0)) for m in self.measures})

    def build(self, requests: DataFrame, changes: DataFrame, initial: DataFrame | None = None) -> None:
        """Compute and store everything; `initial` holds one row per key with what is known at the start."""
        self.steps.replace(self._within(self._summed(requests, changes)), notes={})
        sums = self.steps.read().groupBy(*self.keys, PART).agg(*self._sums())
        if initial is not None:
            start = initial.groupBy(*self.keys).agg(*self._sums()).withColumn(PART, F.lit(_START))
            sums = sums.unionByName(start)
        self.offsets.replace(self._before(sums), notes={"steps": self.steps.manifest().version})

    def _paired(self) -> Manifest:
        """The steps that belong to the offsets; newer ones are left from a correction that broke off."""
        return self.steps.manifest(self.offsets.manifest().notes["steps"])

    def touched(self, games: DataFrame) -> list[str]:
        """The chunks of the games; as many as the calendar has."""
        return sorted(r[0] for r in games.where(F.col(self.order).isNotNull()).select(self._part().alias("p")).distinct().collect())

    def corrected_steps(self, games: DataFrame, changes: DataFrame, requests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The steps of the touched chunks after the correction, and the keys it touches (with the chunk)."""
        now = self.steps.read(self.touched(games), self._paired().version)
        replaced = games.select(self.order).distinct()
        fresh = self._summed(requests, changes.join(replaced, self.order, "left_semi"))
        left = now.join(replaced, self.order, "left_semi")
        keys = [*self.keys, PART]
        moved = left.select(*keys).unionByName(fresh.select(*keys)).distinct()
        of_keys = now.join(moved, keys, "left_semi")
        kept = of_keys.join(replaced, self.order, "left_anti").drop(*[f"in_{m}" for m in self.measures])
        asked = left.where("asked").select(*self.keys, PART, self.order, self.label, "asked", *[F.lit(0).cast("long").alias(m) for m in self.measures])
        again = kept.unionByName(fresh).unionByName(asked).groupBy(*self.keys, PART, self.order, self.label).agg(
            F.bool_or("asked").alias("asked"), *self._sums()
        )
        return self._within(again).unionByName(now.join(moved, keys, "left_anti")), moved

    def correct(self, games: DataFrame, changes: DataFrame, requests: DataFrame | None = None) -> None:
        """Put `changes` in the place of all that is stored for the games (a table with the order column).

        A player who is not in the corrected game any more loses it; what was
        asked for stays asked for, and `requests` adds to it. Both tables switch
        by manifest, and reading asks for the pair that belongs together.
        """
        chunks = self.touched(games)
        if not chunks:
            return
        old_offsets = self.offsets.manifest()
        old_steps = self._paired()._replace(version=self.steps.manifest().version)
        steps, moved = self.corrected_steps(games, changes, requests)
        self.steps.replace(steps, emptied=chunks, notes={}, before=old_steps)
        keys = moved.select(*self.keys).distinct()
        stored = self.offsets.read(version=old_offsets.version)
        now_sums = self.steps.read(chunks).join(moved, [*self.keys, PART], "left_semi").groupBy(*self.keys, PART).agg(*self._sums())
        unmoved = stored.join(keys, self.keys, "left_semi").select(*self.keys, PART, *self.measures)
        history = unmoved.join(moved, [*self.keys, PART], "left_anti").unionByName(now_sums)
        later = [p for p in {*old_offsets.parts, *chunks} if p >= chunks[0]]
        behind = self._before(history).where(F.col(PART).isin(later))
        others = self.offsets.read(later, old_offsets.version).join(keys, self.keys, "left_anti")
        self.offsets.replace(behind.unionByName(others), emptied=later, notes={"steps": self.steps.manifest().version}, before=old_offsets)

    def totals(self) -> DataFrame:
        """(keys, order, label, measures) of every requested game."""
        pair = self.offsets.manifest()
        steps = self.steps.read(version=pair.notes["steps"]).where("asked")
        before = self.offsets.read(version=pair.version).select(*self.keys, PART, *[f"before_{m}" for m in self.measures])
        return steps.join(before, [*self.keys, PART]).select(
            *self.keys, self.order, self.label, *[(F.col(f"in_{m}") + F.col(f"before_{m}")).alias(m) for m in self.measures]
        )
