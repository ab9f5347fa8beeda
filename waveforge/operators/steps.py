"""Stages of loops and chains, written to the shared folder so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}  # application id -> folder, only where one process is the whole session
#: Rows of a table of clusters up to which it is broadcast; larger ones are shuffled to.
BROADCAST_ROWS = 50_000
#: Rows that a task is dealt at most, so that its memory doesn't grow with the input.
TASK_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; sessions on a local master may leave it unset, others may not."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="waveforge-steps-"))


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` from files: a lost executor costs a re-read, and a loop's plan doesn't grow."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def dealt(rows: DataFrame, many: int, *keys: str) -> DataFrame:
    """``rows`` by their keys, in as many partitions as ``many`` rows need, those of the session at least."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // TASK_ROWS))
    return rows.repartition(parts, *keys)


def small(table: DataFrame) -> DataFrame:
    """A written table, with the broadcast hint where it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


class Stages:
    """Writes stages and removes all of them but the last ones on request."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, frame: DataFrame, name: str) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}")
        frame.write.parquet(self.paths[-1])
        return self.spark.read.schema(frame.schema).parquet(self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
