"""Tables in parts, replaced part by part under a manifest that switches in one step.

A part is a folder of Parquet files. A write makes a new folder for the parts it
replaces and then publishes the next manifest, which names the folder of every
part. Readers follow the newest manifest, so they see all of a write or nothing
of it, and they read live rows only. What a crash leaves behind before its
manifest is never read; `sweep` removes it. Paths may be on any file system
that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class Manifest(NamedTuple):
    """One state of a table: the folder of each part, its schema, and what the writer notes about it."""

    version: int
    parts: dict[str, str]
    schema: str | None
    notes: dict


class Conflict(Exception):
    """Another writer has published the same version first."""


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file_system(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file_system()
        at = path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read_text(self, name: str) -> str:
        fs, path = self._file_system()
        stream = fs.open(path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one before the first write."""
        known = self.versions()
        if version is None:
            version = max(known, default=0)
        if not known and version == 0:
            return Manifest(0, {}, None, {})
        return Manifest(**json.loads(self._read_text(f"manifests/{version:010d}.json")))

    def _publish(self, manifest: Manifest) -> None:
        """Write the manifest aside and rename it: it is there as a whole, and only one writer gets a version."""
        fs, path = self._file_system()
        aside = path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        final = path(f"{self.path}/manifests/{manifest.version:010d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest._asdict(), sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise Conflict(f"version {manifest.version} of {self.path} is there already")

    def read(self, parts: Collection[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of all parts, or of the named ones; only their folders are opened. `_part` names the part."""
        now = self.manifest(version)
        if now.schema is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        schema = T.StructType.fromJson(json.loads(now.schema))
        chosen = sorted((p, f) for p, f in now.parts.items() if parts is None or p in set(parts))
        if not chosen:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(PART, T.StringType())]))
        by_folder: dict[str, list[str]] = {}
        for part, folder in chosen:
            by_folder.setdefault(folder, []).append(f"{self.path}/{folder}/{PART}={part}")
        kinds = T.StructType([*schema.fields, T.StructField(PART, T.StringType())])
        frames = [
            self.spark.read.schema(kinds).option("basePath", f"{self.path}/{folder}").parquet(*paths)
            for folder, paths in by_folder.items()
        ]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def replace(self, rows: DataFrame, emptied: Iterable[str] = (), notes: dict | None = None, before: Manifest | None = None) -> Manifest:
        """Write the parts that `rows` name in `_part` anew, drop the emptied ones, and switch.

        A part name is letters, digits, `-` and `_`. The other parts keep their
        folders. Publishing fails where another writer was faster than `before`, the
        state this write started from.
        """
        before = before or self.manifest()
        folder = f"data/{before.version + 1:010d}-{uuid.uuid4().hex}"
        data = rows.select(*[c for c in rows.columns if c != PART], F.col(PART).cast("string"))
        # Rebalancing gathers a part's rows in files of the advised size and splits a part that is larger.
        data.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        written = [n.removeprefix(f"{PART}=") for n in self._names(folder) if n.startswith(f"{PART}=")]
        if any(not p.replace("-", "").replace("_", "").isalnum() for p in written):
            raise ValueError(f"parts are named by letters, digits, - and _: {written[:5]}")
        schema = T.StructType([f for f in data.schema.fields if f.name != PART]).json()
        parts = {p: f for p, f in before.parts.items() if p not in set(emptied)} | {p: folder for p in written}
        now = Manifest(before.version + 1, parts, schema, notes if notes is not None else before.notes)
        self._publish(now)
        return now

    def sweep(self, keep: int = 2) -> int:
        """Remove folders that none of the last `keep` manifests names, and older manifests; readers of those have time to end."""
        fs, path = self._file_system()
        known = sorted(self.versions())
        kept = known[-keep:]
        live = {folder for v in kept for folder in self.manifest(v).parts.values()}
        newest = max(known, default=0)
        gone = 0
        for name in self._names("data"):
            if f"data/{name}" not in live and int(name.split("-")[0]) <= newest:
                fs.delete(path(f"{self.path}/data/{name}"), True)
                gone += 1
        for v in known[:-keep]:
            fs.delete(path(f"{self.path}/manifests/{v:010d}.json"), False)
        return gone


