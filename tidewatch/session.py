"""Session settings and the two ways a plan may be cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A grouping by (series, window) must not run on partitions hashed by series
    # alone: one busy series would then land in a single task.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the recommended settings to a session builder."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and measurements."""
    spark = (
        tuned(SparkSession.builder.master(f"local[{cores}]").appName("tidewatch"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Small local shuffles still use all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever they run; once per Spark application.

    The zip is a file of the driver that Spark itself hands to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_tidewatch_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package came in a zip already
        path = Path(tempfile.mkdtemp(prefix="tidewatch-zip-")) / f"{root.name}-package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
    context._tidewatch_shipped = True


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let rows pass between Spark and Python in batches of `size`, unless the session has its own bound.

    Spark's own bound of 10,000 rows lets a batch grow with the texts, and a task holds several copies of it on both sides. Only the
    session can set this; it holds for what runs from then on.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, size)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a local one only where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix=f"tidewatch-{os.getpid()}-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared checkpoint folder and read it back from there.

    Used where several branches of a plan need the same reduced table: neither the branches nor a
    lost executor then go back to the raw records, and each branch reads only its columns. The shuffle
    files of the write are let go when it ends. The table stays until `discard` gets it, or until the
    checkpoint folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(*tables: DataFrame) -> None:
    """Delete tables that `staged` wrote, once nothing will read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_BYTES = 8 << 20


def stored_bytes(table: DataFrame) -> int:
    """Size of the files of a table that `staged` wrote."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large table to a usually small one, null keys included, whatever their skew.

    `small` is written once. Files of up to `max_bytes` are broadcast and `big` is not shuffled at all.
    Beyond that both sides are shuffled by key, and adaptive execution splits the keys it measures to be hot.
    """
    small = staged(small)
    right = small.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                         *[c for c in small.columns if c not in on])
    right = F.broadcast(right) if stored_bytes(small) <= max_bytes else right
    return big.join(right, _same(on), how).drop(*[f"_r_{c}" for c in on])


def _same(on: list[str]) -> Column:
    condition = F.lit(True)
    for name in on:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    return condition
