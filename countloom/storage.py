"""Sessions for local work, and cutting lineage through written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "countloom") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the one named by ``spark.checkpoint.dir`` (or set on the context).
    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would be wrong, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="countloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/countloom-{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and continue from the written table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage of ``df`` by a written table in the shared folder.

    Unlike a cached frame the table survives the loss of executors, and Spark
    learns its true size, which it needs to choose join strategies.
    """
    return write_and_read(df, scratch_path(df.sparkSession, name))


class TwoSlots:
    """Two alternating tables for the state of a driver loop.

    Step t reads one slot and writes the other, so a loop of any length holds
    two versions on disk.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = scratch_path(spark, name)
        self._paths = [f"{base}/a", f"{base}/b"]
        self._turn = 0

    def next_path(self) -> str:
        path = self._paths[self._turn]
        self._turn = 1 - self._turn
        return path

    def write(self, df: DataFrame) -> DataFrame:
        return write_and_read(df, self.next_path())
