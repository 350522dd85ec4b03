"""Session helpers: a local session for tests and the bench, and scratch space.

Library code never builds a session on its own; it takes the one it is given
through the DataFrames it works on.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "scorebook", memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Rows for which `dealt` gives a task of its own.
ROWS_A_TASK = 250_000


def tasks_beyond(spark: SparkSession, rows: int) -> int:
    """Tasks of ROWS_A_TASK for so many rows where these are more than the session's shuffle partitions, else 0."""
    tasks = -(-rows // ROWS_A_TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt by `keys` to one task per ROWS_A_TASK of `rows`.

    What a task sorts then stays the same size however large the tables are. Where
    the session's own number of shuffle partitions is enough, it stays Spark's choice.
    """
    tasks = tasks_beyond(df.sparkSession, rows)
    return df.repartition(tasks, *keys) if tasks else df


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A session without that setting gets a temporary folder, but only when driver
    and executors are one process: on a cluster a folder of one machine is
    invisible to the others, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="scorebook-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the application, once; Spark distributes the archive."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scorebook-code-")) / "scorebook.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table, in a folder per application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/scorebook/{app}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise on the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as a table on the shared folder and read back.

    For results that several jobs read: the work is done once, the table
    survives lost executors, and later scans read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While open, a write that ends drops its shuffle files at once, not when the driver's garbage is collected."""
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP) if before is None else spark.conf.set(_DROP, before)


def discard(df: DataFrame) -> None:
    """Delete the tables of `materialized` that a frame reads; nothing may read them afterwards, and other files stay."""
    context = df.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if f"/scorebook/{context.applicationId}/" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
