"""What the operators share: staged tables, batch sizes, reading of tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from brindle.staging import discard, reclaim, shuffles_removed, staged

__all__ = ["bound_batches", "discard", "reclaim", "shuffle_partitions", "shuffles_removed", "staged", "table"]


#: Rows that cross to Python at a time at most: texts are long, and both sides hold a whole batch.
TEXT_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to TEXT_ROWS rows, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
