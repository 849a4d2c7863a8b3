"""Stores as Parquet tables: chunks, embeddings and cells by configuration, answers, and runs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from querent.functions.vectors import normalised


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name)


def cache_path(root: str, kind: str, params: dict) -> str:
    """A path by all index parameters, so that no index serves another one's configuration."""
    key = hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"{root.rstrip('/')}/{kind}-{slug(str(params.get('embed_model', 'none')))}-{params.get('chunk_max_tokens', 0)}-{key}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table with a row at least is there."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def loaded_or_built(spark: SparkSession, path: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table at ``path``, written first if it isn't there; ``by`` lays it out in folders that joins can prune."""
    if not exists(spark, path):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.parquet(path)


def invalidate(spark: SparkSession, path: str) -> None:
    """Deletes a table, as after a change of the corpus."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save_cells(filed: DataFrame, centroids: DataFrame, path: str) -> None:
    """Replaces a stored index: vectors (id, embedding, cell_id, ...) laid out by cell, so that row groups can be pruned, and its centres."""
    filed.repartitionByRange("cell_id", F.xxhash64("id")).sortWithinPartitions("cell_id").write.mode("overwrite").parquet(f"{path}/cells")
    centroids.write.mode("overwrite").parquet(f"{path}/centres")


def load_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The vectors with their cells, and the centres."""
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centres")


def first_vectors(base: DataFrame, asked: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` vectors (id, embedding) of ``base`` and the ``m`` of ``asked`` with the smallest ids, at length one; all where there are fewer."""
    first = lambda df, rows: df.orderBy("id").limit(rows).select("id", normalised(F.col("embedding")).alias("embedding"))
    return first(base, n), first(asked, m)


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the stored chunks (id, text, source)."""
    chunks.select("id", "text", "source").write.mode("overwrite").parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("id")


def add_chunks(spark: SparkSession, chunks: DataFrame, path: str) -> None:
    """Appends the chunks whose text isn't stored yet."""
    key = F.md5(F.col("text").cast("binary"))
    if exists(spark, path):
        chunks = chunks.join(spark.read.parquet(path).select(key.alias("known")), key == F.col("known"), "left_anti")
    chunks.select("id", "text", "source").write.mode("append").parquet(path)


ANSWERS = T.StructType([T.StructField("key", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("at", T.TimestampType())])


def cached_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer): the latest answer of each key; none where nothing is stored."""
    if not exists(spark, path):
        return spark.createDataFrame([], ANSWERS).select("key", "answer")
    order = Window.partitionBy("key").orderBy(F.desc("at"), "answer")
    return spark.read.parquet(path).withColumn("n", F.row_number().over(order)).where("n = 1").select("key", "answer")


def cache_answers(answers: DataFrame, path: str) -> None:
    answers.select("key", "answer", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, experiment: str, name: str, params: dict, metrics: dict) -> None:
    """Appends a run with its parameters and metrics."""
    schema = "experiment string, run_name string, params map<string,string>, metrics map<string,double>"
    row = (experiment, name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})
    spark.createDataFrame([row], schema).withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """The latest run of each name, best accuracy first."""
    order = Window.partitionBy("run_name").orderBy(F.desc("ts"))
    rows = spark.read.parquet(path).where(F.col("experiment") == experiment).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return rows.orderBy(F.desc(F.try_element_at("metrics", F.lit("accuracy"))), "run_name")
