"""Dated snapshots: built once, then read back. Also report sinks."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session, whose executors are this machine, falls back to a new
    temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="sentinela-")
    raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by the cluster")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@dataclass(frozen=True)
class Snapshots:
    """Parquet tables under ``<root>/as_of=<date>/<name>``; ``as_of=None`` is undated."""

    spark: SparkSession
    root: str
    as_of: dt.date | None

    def path(self, name: str) -> str:
        dated = self.root if self.as_of is None else f"{self.root}/as_of={self.as_of}"
        return f"{dated}/{name}"

    def complete(self, name: str) -> bool:
        """Whether a write of this table has finished."""
        return _exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def bytes(self, name: str) -> int:
        """Stored size of a table."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(target).getLength()

    def write(self, name: str, table: DataFrame) -> None:
        """Store a table. A finished one is never replaced, the rest of a lost job is."""
        if self.complete(name):
            raise FileExistsError(f"snapshot exists: {self.path(name)}")
        table.write.mode("overwrite").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Read the snapshot, building and storing it first if there is none yet."""
        if not self.complete(name):
            self.write(name, build())
        return self.read(name)


def write_report(table: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write a result table as parquet, csv, json or orc; an existing one is an error."""
    writer = table.write.mode("errorifexists")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)
