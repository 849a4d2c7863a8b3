"""Made-up vectors and documents for load tests; a row depends on its id and the seed only, not on partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(spark: SparkSession, n: int, size: int, seed: int = 0) -> DataFrame:
    """(id, embedding): standard normal components at unit length."""

    def run(batches):
        for batch in batches:
            rows = np.array([np.random.default_rng([seed, i]).normal(size=size) for i in batch.column("id").to_pylist()]).reshape(-1, size)
            rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["id", "embedding"])

    return spark.range(n).mapInArrow(run, "id long, embedding array<double>")


def documents(spark: SparkSession, n: int) -> DataFrame:
    """(id, text, source): the row's number as its text."""
    return spark.range(n).select("id", F.col("id").cast("string").alias("text"), F.lit("synthetic").alias("source"))
