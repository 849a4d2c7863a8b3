"""Sweeps over retrievers as queries, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.operators import evaluation
from querent.plans import sweeps
from querent.plans.search_queries import HYBRID, text_queries
from querent.tables import spread, table

METRICS = (*(f"ndcg_{k}" for k in evaluation.CUTS), "recall", "rr", "ap")


def ranking_grid(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and vectors over whole documents; the labels of quality stand for judgements, dealt over the benchmark items by id."""
    corpus = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    qrels = table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("id"), F.col("quality").alias("rel"))
    rows = sweeps.ranking_runs(corpus, text_queries(spark, sf), qrels, ("bm25", "dense"))
    return rows.select("config", "queries", *(F.round(c, 6).alias(c) for c in METRICS))


QUERIES = {f.__name__: f for f in (ranking_grid,)}
ORACLES = {
    "ranking_grid": f"WITH {HYBRID}, qrels AS (SELECT doc_id % 40 AS qid, doc_id AS id, quality AS rel FROM labels), g AS (SELECT qid, count(*) FILTER (rel > 0) AS n FROM qrels GROUP BY qid),"
    " hits AS (SELECT 'bm25' AS config, qid, id, score FROM lex UNION ALL SELECT 'dense', qid, id, score FROM dense),"
    " run AS (SELECT * FROM hits WHERE qid IN (SELECT qid FROM g) QUALIFY row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, id) <= 100),"
    " o AS (SELECT config, qid, coalesce(rel, 0) AS rel, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, id::VARCHAR DESC) AS place FROM run LEFT JOIN qrels USING (qid, id)),"
    " sw AS (SELECT *, sum((rel > 0)::INTEGER) OVER (PARTITION BY config, qid ORDER BY place) AS seen FROM o), tens AS (SELECT unnest(range(1, 11)) AS r), per AS (SELECT config, qid, "
    + ", ".join(f"coalesce(coalesce(sum(rel / log2(place + 1)) FILTER (place <= {k}), 0) / (SELECT sum(1 / log2(r + 1)) FROM tens WHERE r <= least({k}, any_value(n))), 0) AS ndcg_{k}" for k in evaluation.CUTS)
    + ", coalesce(coalesce(sum((rel > 0)::INTEGER), 0) / nullif(any_value(n), 0)::DOUBLE, 0) AS recall, coalesce(1.0::DOUBLE / min(place) FILTER (rel > 0), 0) AS rr, coalesce(coalesce(sum(seen / place::DOUBLE) FILTER (rel > 0), 0) / nullif(any_value(n), 0)::DOUBLE, 0) AS ap FROM sw JOIN g USING (qid) GROUP BY config, qid)"
    + f" SELECT config, count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in METRICS)} FROM per GROUP BY config",
}
