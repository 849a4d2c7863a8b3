"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a table that one task is meant to read.
TASK_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores and in tasks of about TASK_BYTES; a table that is stored in as many splits stays as it is."""
    query = rows._jdf.queryExecution()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(str(query.optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    return rows.repartition(tasks) if query.toRdd().getNumPartitions() < tasks else rows
