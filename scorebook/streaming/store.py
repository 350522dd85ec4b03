"""A store of keyed rows that a stream writes to: the newest row of a key counts.

Micro-batches land as folders under their own number, so a replayed batch
overwrites itself. Compaction merges them into a table in buckets by key, of
which it rewrites those that the batches touch, and switches by manifest; the
manifest notes the last batch it holds. Reading takes the live rows of the
buckets and merges only the batches that are not in yet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook.sources.generations import PART, Generations

BUCKETS = 16


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.table = Generations(spark, f"{self.path}/merged")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Land a micro-batch under its number."""
        if "_batch" in batch.columns:
            raise ValueError("the column _batch is the store's own")
        if batch_id > self.merged_upto():
            batch.write.mode("overwrite").parquet(f"{self.path}/batches/_batch={batch_id}")

    def merged_upto(self) -> int:
        """Number of the last batch that the merged table holds; -1 before the first compaction."""
        return self.table.manifest().notes.get("upto", -1)

    def landed(self) -> list[int]:
        """Batches that are not in the merged table yet."""
        landing = Generations(self.spark, self.path)
        found = [int(n.split("=")[1]) for n in landing._names("batches") if n.startswith("_batch=")]
        upto = self.merged_upto()
        return sorted(b for b in found if b > upto)

    def _batches(self, numbers: Sequence[int]) -> DataFrame:
        paths = [f"{self.path}/batches/_batch={b}" for b in numbers]
        rows = self.spark.read.option("basePath", f"{self.path}/batches").parquet(*paths)
        return rows.withColumn("_batch", F.col("_batch").cast("long"))

    def _part(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key: the newest batch's; of several in one batch the one with the largest hash, so reruns agree."""
        values = [c for c in rows.columns if c != "_batch"]
        order = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"), F.desc(F.xxhash64(*values)))
        return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")

    def read(self) -> DataFrame:
        """The newest row of every key. Without batches to merge this is a scan of the merged table."""
        now, waiting = self.table.manifest(), self.landed()
        merged = self.table.read().drop(PART) if now.schema else None
        if not waiting:
            if merged is None:
                raise FileNotFoundError(f"{self.path} holds no batch")
            return merged
        fresh = self._batches(waiting)
        if merged is not None:
            fresh = fresh.unionByName(merged.withColumn("_batch", F.lit(-1).cast("long")), allowMissingColumns=True)
        return self._newest(fresh).drop("_batch")

    def compact(self) -> bool:
        """Merge the waiting batches: rewrite the buckets they touch, switch, then remove what is merged."""
        before, waiting = self.table.manifest(), self.landed()
        if not waiting:
            return False
        fresh = self._batches(waiting)
        touched = [r[0] for r in fresh.select(self._part().alias("p")).distinct().collect()]  # as many as buckets
        rows = fresh
        if before.schema and set(touched) & set(before.parts):
            old = self.table.read(touched, before.version).drop(PART)
            rows = fresh.unionByName(old.withColumn("_batch", F.lit(-1).cast("long")), allowMissingColumns=True)
        merged = self._newest(rows).drop("_batch").withColumn(PART, self._part())
        self.table.replace(merged, notes={"upto": max(waiting)}, before=before)
        self.clean()
        return True

    def clean(self, keep: int = 2) -> None:
        """Remove what none of the last `keep` manifests needs, batches too; safe to repeat after a crash."""
        landing = Generations(self.spark, self.path)
        fs, path = landing._file_system()
        recent = sorted(self.table.versions())[-keep:]
        upto = self.table.manifest(recent[0]).notes["upto"] if len(recent) == keep else -1
        for name in landing._names("batches"):
            if name.startswith("_batch=") and int(name.split("=")[1]) <= upto:
                fs.delete(path(f"{self.path}/batches/{name}"), True)
        self.table.sweep(keep)

    def writer(self, every: int = 10) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: land each batch, and compact when `every` of them wait."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            if len(self.landed()) >= every:
                self.compact()

        return write
