"""Grids of configurations: answer accuracy, ranking quality, and vector search at growing sizes."""

from __future__ import annotations

import time
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import prompts
from querent.functions.text import is_yes, keyword_score
from querent.functions.vectors import Embed, embedded, hash_embed
from querent.operators import evaluation, fusion, lexical, vector
from querent.plans.answering import Generate, answered, build_index, extractive, generated
from querent.plans.config import INDEX, Config
from querent.session import stored
from querent.sources import synthetic


def qa_report(chunks: DataFrame, questions: DataFrame, configs: dict[str, Config], generate: Generate = extractive) -> DataFrame:
    """(config, qid, answer, right, judge) of questions (qid, qtext, expected, keywords) with keywords, under each configuration.

    Configurations with the same index share it.
    """
    asked = questions.where(F.size("keywords") > 0)
    built: dict = {}
    out = None
    for name, config in configs.items():
        key = tuple(config.group(INDEX).items())
        if not config.no_rag and key not in built:
            built[key] = build_index(chunks, config)
        rows = answered(built.get(key), asked.select("qid", "qtext"), config, generate).select("qid", "answer").join(asked, "qid")
        judged = prompts.filled(prompts.JUDGE, question=F.col("qtext"), expected=F.col("expected"), answer=F.col("answer"))
        rows = generated(rows.withColumn("prompt", judged), "prompt", "reply", generate)
        rows = rows.select(F.lit(name).alias("config"), "qid", "answer", keyword_score(F.col("answer"), F.col("keywords")).alias("right"), is_yes(F.col("reply")).alias("judge"))
        out = rows if out is None else out.unionByName(rows)
    return stored(out, "qa-report")


def qa_accuracy(report: DataFrame) -> DataFrame:
    """Accuracy by keywords and judge of each configuration."""
    return evaluation.accuracy(report, "config").where("config IS NOT NULL")


def ranking_runs(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, kinds: Iterable[str] = ("bm25", "dense", "hybrid"), depth: int = 100, embed: Embed = hash_embed) -> DataFrame:
    """(config, queries, ndcg_k..., recall, rr, ap): each retriever over whole documents (id long, text), for judged queries (qid long, qtext)."""
    chunks = corpus.select("id", "text", F.col("id").cast("string").alias("source"))
    asked = stored(queries.join(qrels.select("qid").distinct(), "qid", "left_semi"), "judged-queries")
    words = lambda k: lexical.top_k(asked, lexical.indexed(chunks), k)
    dense = lambda k: vector.exact_top_k(embedded(asked, "qtext", "qvec", embed), embedded(chunks, embed=embed), k)

    def hybrid(k: int) -> DataFrame:
        own = lambda hits: hits.join(chunks, "id").select("qid", "id", "text", "source", "score", "rank")
        return fusion.rrf(own(dense(3 * k)), own(words(3 * k)), k).select("qid", F.col("source").cast("long").alias("id"), "score")

    makers = {"bm25": words, "dense": dense, "hybrid": hybrid}
    out = None
    for kind in kinds:
        run = makers[kind](depth).select("qid", "id", "score")
        row = evaluation.macro(evaluation.ir_metrics(*evaluation.judged(run, qrels))).withColumn("config", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


BACKENDS = ("numpy", "faiss-flat", "faiss-ivf", "qdrant")


def scale_cells(spark: SparkSession, sizes: Iterable[int], backends: Iterable[str] = BACKENDS, size: int = 64, queries: int = 20, k: int = 10, probes: int = 16, seed: int = 0) -> DataFrame:
    """(backend, n, dim, top_k, queries, nprobe, build_time_s, latency_p50_ms, latency_p95_ms, recall_at_k): a row per cell; queries are timed one by one."""
    rows = []
    for n in sizes:
        own = stored(synthetic.vectors(spark, n, size, seed), "scale")
        asked = stored(synthetic.vectors(spark, queries, size, seed + 1).toDF("qid", "qvec"), "scale-queries")
        exact = stored(vector.exact_top_k(asked, own, k), "scale-exact")
        for backend in backends:
            began = time.perf_counter()
            if backend == "faiss-ivf":
                centroids = stored(vector.trained_centroids(own, vector.cell_count(n), seed), "scale-centres")
                filed = stored(vector.assigned(own, centroids), "scale-cells")
                search = lambda q: vector.ivf_top_k(q, filed, centroids, k, probes)
            elif backend == "qdrant":  # hashing stands in for the server's graph
                hashing = vector.fitted_hashing(own, k)
                search = lambda q: vector.lsh_top_k(q, own, k, hashing)
            elif backend in ("numpy", "faiss-flat"):  # made-up vectors have length one, so inner products are cosines
                search = lambda q: vector.exact_top_k(q, own, k, cosine=backend == "numpy")
            else:
                raise ValueError(f"no backend {backend!r}")
            build, times = time.perf_counter() - began, []
            for q in range(queries):
                began = time.perf_counter()
                search(asked.where(F.col("qid") == q)).collect()
                times.append(1000 * (time.perf_counter() - began))
            reached = vector.recall(search(asked), exact, k).agg(F.avg("recall")).first()[0]
            rows.append((backend, n, size, k, queries, probes if backend == "faiss-ivf" else None, build, float(np.percentile(times, 50)), float(np.percentile(times, 95)), reached))
    return spark.createDataFrame(rows, "backend string, n long, dim int, top_k int, queries int, nprobe int, build_time_s double, latency_p50_ms double, latency_p95_ms double, recall_at_k double")
