"""Session settings the jobs are tuned for; none of them changes a result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan from real sizes: broadcast small sides, split skewed ones, merge small tasks.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods above 8,000 bytes. Wide rule projections exceed
    # that when fused into one method; this limit lets Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Bytes one shuffle task should hold, and the share of the input a wide shuffle moves
# once columns are pruned and duplicates dropped. Used to size partitions for large inputs.
TASK_BYTES = 1024 ** 3
SHUFFLED_SHARE = 0.25
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_settings(input_bytes: int) -> dict[str, str]:
    """Partition settings for an input of the given size.

    The starting number of shuffle partitions grows with the input: adaptive execution
    merges what turns out small, but it cannot split an ordinary shuffle.
    """
    partitions = max(200, round(input_bytes * SHUFFLED_SHARE / TASK_BYTES))
    return {
        PARTITIONS: str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.files.maxPartitionBytes": "256m",
    }


def _starting(spark: SparkSession) -> int:
    return int(spark.conf.get(PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _partitions(spark: SparkSession, number: int) -> Iterator[None]:
    before = spark.conf.get(PARTITIONS, None)
    spark.conf.set(PARTITIONS, str(number))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PARTITIONS)
        else:
            spark.conf.set(PARTITIONS, before)


def partitions_for(spark: SparkSession, stored_bytes: int):
    """Start shuffles of a table of this stored size with enough partitions for all its rows.

    Stored columns are compressed; rows in a shuffle take about four times as much.
    """
    return _partitions(spark, max(_starting(spark), -(-stored_bytes * 4 // TASK_BYTES)))


def at_most_partitions(spark: SparkSession, most: int):
    """Start shuffles with at most this many partitions, for jobs that shuffle only counts.

    Every map task writes an entry per partition, which for thousands of partitions and
    a few counts is more than the counts themselves.
    """
    return _partitions(spark, min(_starting(spark), most))


def tune(builder: SparkSession.Builder, input_bytes: int | None = None) -> SparkSession.Builder:
    """Add the settings to a session builder; ``input_bytes`` also sizes the partitions."""
    sized = {} if input_bytes is None else size_settings(input_bytes)
    for name, value in (SETTINGS | sized).items():
        builder = builder.config(name, value)
    return builder
