"""Fusion of ranked lists, re-ranking and comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions.text import tokens

#: Fixed value: the rank constant of reciprocal-rank fusion.
RRF_K = 60


def arms(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """One row per query and text: each arm's last rank and score there, and where the text was first seen.

    Lists are (qid, id, text, source, score, rank); equal texts are one result, as in a table keyed by text.
    """
    own = dense.withColumn("arm", F.lit(0)).unionByName(lexical.withColumn("arm", F.lit(1)))
    own = own.withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("seen", F.struct("arm", "rank"))
    last = lambda arm, c: F.max_by(F.when(F.col("arm") == arm, F.col(c)), F.when(F.col("arm") == arm, F.col("rank")))
    return own.groupBy("qid", "key").agg(
        F.min("seen").alias("seen"),
        F.min_by("text", "seen").alias("text"),
        F.min_by("source", "seen").alias("source"),
        last(0, "rank").alias("d_rank"),
        last(1, "rank").alias("l_rank"),
        last(0, "score").alias("d_score"),
        last(1, "score").alias("l_score"),
    )


def fused(rows: DataFrame, score: Column, k: int, digits: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    rows = rows.withColumn("score", F.round(score, digits)).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select("qid", "rank", "text", "source", "score")


def rrf(dense: DataFrame, lexical: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, rank, text, source, score) by the sum of 1 / (60 + rank); ties in the order in which texts were first seen."""
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    return fused(arms(dense, lexical), part("d_rank") + part("l_rank"), k, digits)


def min_maxed(hits: DataFrame, into: str = "score") -> DataFrame:
    """Scores from 0 to 1 within each query; all 0 where they are equal."""
    own = Window.partitionBy("qid")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return hits.withColumn(into, (F.col("score") - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def weighted(dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.5, digits: int = 6) -> DataFrame:
    """(qid, rank, text, source, score) by alpha times the dense and 1 - alpha times the lexical score, each min-maxed."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return fused(arms(min_maxed(dense), min_maxed(lexical)), alpha * part("d_score") + (1 - alpha) * part("l_score"), k, digits)


FUSIONS = {"rrf": rrf, "weighted": weighted}


def fusion(kind: str, dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    if kind not in FUSIONS:
        raise ValueError(f"no fusion {kind!r}")
    return weighted(dense, lexical, k, alpha) if kind == "weighted" else rrf(dense, lexical, k)


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that the text has: the default scorer of pairs."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked))


def reranked(hits: DataFrame, queries: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap, digits: int = 6) -> DataFrame:
    """``hits`` scored anew as pairs of question and text; ties keep the former order."""
    rows = hits.join(queries.select("qid", "qtext"), "qid").withColumn("score", F.round(scorer(F.col("qtext"), F.col("text")), digits)).withColumnRenamed("rank", "former")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "former")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "text", "source", "score")


def compared(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two ranked lists as one, by ``side``."""
    return a.withColumn("side", F.lit(names[0])).unionByName(b.withColumn("side", F.lit(names[1])))
