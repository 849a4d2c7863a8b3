"""Every query of the engine, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querent.plans import file_queries, search_queries, sentence_queries, store_queries, stream_queries, sweep_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search_queries.QUERIES, **text_queries.QUERIES, **store_queries.QUERIES, **stream_queries.QUERIES, **file_queries.QUERIES, **sentence_queries.QUERIES, **sweep_queries.QUERIES}
ORACLES: dict[str, str] = {**search_queries.ORACLES, **text_queries.ORACLES, **store_queries.ORACLES, **stream_queries.ORACLES, **file_queries.ORACLES, **sentence_queries.ORACLES, **sweep_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval by reciprocal-rank fusion."""
    return search_queries.hybrid_rrf(spark, sf_dir)
