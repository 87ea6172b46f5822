"""Session settings the jobs are written for; existing cluster settings always win."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # cut session rows into finished sessions before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "isotherm") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints and staged tables go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only where that is
    unset (tests, a laptop) a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="isotherm-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The frame as a written table: later passes read it instead of repeating its lineage.

    Used between the stages of multi-pass jobs. The table lies in the shared folder, so it
    outlives any executor. ``codec`` is that of Parquet, for tables that weigh much.
    """
    path = staging_path(df.sparkSession, name)
    for paths in _RECORDERS:
        paths.append(path)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: path of each frame that ``materialize`` returned, while the frame lives
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_RECORDERS: list[list[str]] = []


#: rows of a written table that may be broadcast; they take some 50 MB of the driver
BROADCAST_ROWS = 500_000


def weighed(table: DataFrame) -> DataFrame:
    """A written table, kept from being broadcast where it has more than ``BROADCAST_ROWS`` rows.

    Spark sizes it by its files, where numbers that rise from row to row take a twentieth of what they take in a broadcast.
    The rows are counted from the files' footers.
    """
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")


def delete_staged(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete staged tables by path; one that is gone already is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``materialize`` returned, after their last reader has run.

    Nothing may read them later, directly or through a frame made from them.
    """
    for frame in frames:
        path = _PATHS.pop(frame, None)
        if path is not None:
            delete_staged(frame.sparkSession, [path])


def free_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go. Spark deletes them when the driver's JVM has collected their plans, which a
    driver with room to spare may put off for half an hour; call it between the stages of a job that shuffles much."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``materialize`` writes inside the block, so that they can be deleted when its results are read."""
    paths: list[str] = []
    _RECORDERS.append(paths)
    try:
        yield paths
    finally:
        _RECORDERS[:] = [r for r in _RECORDERS if r is not paths]
