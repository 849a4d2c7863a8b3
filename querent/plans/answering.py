"""Questions to answers: an index, retrieval, prompts and a generator, over tables of questions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from querent.functions import prompts
from querent.functions.text import cache_key, stripped
from querent.functions.vectors import Embed, embedded, hash_embed, normalised
from querent.operators import fusion, lexical, vector
from querent.operators.grids import ordered
from querent.plans.config import Config, as_sources
from querent.sources.stores import cache_answers, cached_answers
from querent.session import stored

Generate = Callable[[list[str]], list[str]]


def extractive(texts: list[str]) -> list[str]:
    """Answers without a model: the context's sentence that shares most words with the question, the question itself for
    passages and rewrites, and YES where a candidate holds the reference."""

    def between(text: str, start: str, end: str) -> str:
        return text.rpartition(start)[2].partition(end)[0].strip()

    def one(text: str) -> str:
        if "Standalone question:" in text:
            return between(text, "Follow-up question:", "\n\nStandalone question:")
        if text.rstrip().endswith("Passage:"):
            return between(text, "Question:", "\n\nPassage:")
        if "Candidate answer:" in text:
            return "YES" if between(text, "Reference answer:", "\nCandidate").lower() in between(text, "Candidate answer:", "\n\nDoes").lower() else "NO"
        asked = set(between(text, "Question:\n", "\n\nAnswer:").lower().split())
        context = between(text, "Context:\n", "\n\nQuestion:") if "Context:\n" in text else ""
        found = [s for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip()]
        return max(found, key=lambda s: len(asked & set(s.lower().split()))) if found else "I am not sure."

    return [one(t) for t in texts]


def generated(df: DataFrame, prompt: str, into: str, generate: Generate = extractive, batch_rows: int = 64, error: str | None = None) -> DataFrame:
    """``df`` with the reply to the column ``prompt``; a null prompt has a null reply.

    What ``generate`` raises ends the job, unless ``error`` names a column for it: prompts of a batch that fails are then asked one by one,
    and those that fail again have a null reply.
    """
    new = [into, *([error] if error else [])]
    schema = T.StructType([*(f for f in df.schema if f.name not in new), *(T.StructField(n, T.StringType()) for n in new)])
    arrow = to_arrow_schema(schema)

    def asked_of(prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
        try:
            return generate(prompts), [None] * len(prompts)
        except Exception as e:  # noqa: BLE001 - whatever a model raises is reported with its row
            if not error:
                raise
            if len(prompts) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            parts = [asked_of([p]) for p in prompts]
            return [r for replies, _ in parts for r in replies], [x for _, errors in parts for x in errors]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                part = whole.slice(at, batch_rows)
                asked = part.column(prompt).to_pylist()
                columns = map(iter, asked_of([p for p in asked if p is not None]))
                own = {n: pa.array([None if p is None else next(c) for p in asked], pa.string()) for n, c in zip((into, error), columns, strict=True)}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in new else part.column(f.name) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


@dataclass
class Index:
    """What a configuration's index group builds over chunks (id, text, source)."""

    config: Config
    chunks: DataFrame
    embed: Embed
    vectors: DataFrame | None = None
    centroids: DataFrame | None = None
    probes: int = 16
    hashing: vector.Hashing | None = None
    words: lexical.Index | None = None


def build_index(chunks: DataFrame, config: Config, embed: Embed = hash_embed) -> Index:
    index = Index(config, chunks, embed)
    if config.retriever in ("dense", "hybrid"):
        index.vectors = stored(embedded(chunks, embed=embed), "vectors")
        if config.store == "faiss" and config.index_type == "ivf":
            index.centroids = vector.trained_centroids(index.vectors, vector.cell_count(index.vectors.count()))
            index.vectors = stored(vector.assigned(index.vectors, index.centroids), "cells")
            index.probes = max(index.probes, vector.fitted_probes(index.vectors, index.centroids, 3 * config.top_k))
        if config.store == "qdrant":
            index.hashing = vector.fitted_hashing(index.vectors, 3 * config.top_k)
    if config.retriever in ("bm25", "hybrid"):
        index.words = lexical.indexed(chunks)
    return index


def retrieved(index: Index, queries: DataFrame, k: int, sources: set[str] | None = None, kind: str = "rrf", alpha: float = 0.5) -> DataFrame:
    """(qid, rank, text, source, score) for queries (qid, qtext): by the index's retriever, restricted to ``sources``."""
    if kind not in fusion.FUSIONS:
        raise ValueError(f"no fusion {kind!r}")

    def with_text(hits: DataFrame) -> DataFrame:
        return stored(hits, "hits").join(index.chunks.select("id", "text", "source"), "id").select("qid", "id", "text", "source", "score", "rank")

    def dense(n: int) -> DataFrame:
        asked = embedded(queries.select("qid", "qtext"), "qtext", "qvec", index.embed)
        allowed = index.vectors if sources is None else index.vectors.where(F.col("source").isin(*sources) if sources else F.lit(False))
        if index.centroids is not None:
            return with_text(vector.ivf_top_k(asked, allowed, index.centroids, n, index.probes))
        if index.config.store == "qdrant":  # hashing stands in for the server's graph
            return with_text(vector.lsh_top_k(asked, allowed, n, index.hashing))
        if index.config.store == "faiss":  # inner products of unit vectors
            unit = lambda df, c: df.withColumn(c, normalised(F.col(c)))
            return with_text(vector.exact_top_k(unit(asked, "qvec"), unit(allowed, "embedding"), n, cosine=False))
        return with_text(vector.exact_top_k(asked, allowed, n))

    def words(n: int) -> DataFrame:
        allow = None
        if sources is not None:
            allow = queries.select("qid", F.explode(F.array(*map(F.lit, sorted(sources))) if sources else F.array().cast("array<string>")).alias("source"))
        return with_text(lexical.top_k(queries, index.words, n, allow))

    if index.config.retriever == "hybrid":
        return fusion.fusion(kind, dense(3 * k), words(3 * k), k, alpha)
    return (words(k) if index.config.retriever == "bm25" else dense(k)).select("qid", "rank", "text", "source", "score")


def answered(index: Index | None, questions: DataFrame, config: Config, generate: Generate = extractive, scorer: Callable[[Column, Column], Column] = fusion.overlap, error: str | None = None) -> DataFrame:
    """(qid, answer, chunks, hyde_doc, standalone_query[, error]) of questions (qid, qtext[, history array<struct<role, text>>]).

    A history condenses the question for retrieval and re-ranking, and shows in the answer's prompt together with the raw question.
    ``error`` names a column for what the model raises while it answers; without it that ends the job.
    """
    has_history = "history" in questions.columns
    failed = [error] if error else []
    asked = questions if has_history else questions.withColumn("history", F.lit(None).cast("array<struct<role:string,text:string>>"))
    talk = F.coalesce(F.size("history"), F.lit(0)) > 0
    shown = F.when(talk, prompts.history_text(F.col("history")))
    asked = asked.withColumn("shown", shown)
    if config.no_rag:
        prompt = F.when(talk, prompts.filled(prompts.NO_RAG_CHAT, history=F.col("shown"), query=F.col("qtext"))).otherwise(prompts.filled(prompts.NO_RAG, query=F.col("qtext")))
        rows = generated(asked.withColumn("prompt", prompt), "prompt", "answer", generate, error=error)
        none = F.array().cast("array<struct<rank:int,text:string,source:string,score:double>>")
        return rows.select("qid", "answer", none.alias("chunks"), F.lit(None).cast("string").alias("hyde_doc"), F.lit(None).cast("string").alias("standalone_query"), *failed)
    if index is None:
        raise ValueError("an index is needed unless no_rag is set")
    if has_history:
        asked = generated(asked.withColumn("prompt", F.when(talk, prompts.filled(prompts.CONDENSE, history=F.col("shown"), query=F.col("qtext")))), "prompt", "condensed", generate)
        asked = asked.withColumn("standalone", F.when(talk, stripped(F.col("condensed"))).otherwise(F.col("qtext")))
    else:
        asked = asked.withColumn("standalone", F.col("qtext"))
    if config.hyde:
        asked = generated(asked.withColumn("prompt", prompts.filled(prompts.HYDE, query=F.col("standalone"))), "prompt", "hyde_doc", generate)
    else:
        asked = asked.withColumn("hyde_doc", F.lit(None).cast("string"))
    asked = stored(asked.drop("prompt", "condensed"), "questions")
    queries = asked.select("qid", F.coalesce("hyde_doc", "standalone").alias("qtext"))
    hits = retrieved(index, queries, 3 * config.top_k if config.rerank else config.top_k, as_sources(config.source), config.fusion, config.alpha)
    if config.rerank:
        hits = fusion.reranked(hits, asked.select("qid", F.col("standalone").alias("qtext")), config.top_k, scorer)
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "text", "source", "score"))).alias("chunks"), ordered(F.col("text"), "rank", "\n\n").alias("context"))
    rows = asked.join(found, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.when(talk, prompts.filled(prompts.RAG_CHAT, history=F.col("shown"), context=F.col("context"), query=F.col("qtext"))).otherwise(prompts.filled(prompts.RAG, context=F.col("context"), query=F.col("qtext")))
    rows = generated(rows.withColumn("prompt", prompt), "prompt", "answer", generate, error=error)
    changed = F.when(talk & (F.col("standalone") != F.col("qtext")), F.col("standalone"))
    return rows.select("qid", "answer", F.coalesce("chunks", F.array().cast("array<struct<rank:int,text:string,source:string,score:double>>")).alias("chunks"), "hyde_doc", changed.alias("standalone_query"), *failed)


def key_columns(config: Config) -> list[Column]:
    """The settings of an answer's key, in the order of their names."""
    return [F.lit(str(v)).alias(k) for k, v in sorted({n: getattr(config, n) for n in vars(config)}.items())]


def answered_through_cache(build: Callable[[], Index | None], questions: DataFrame, config: Config, path: str, generate: Generate = extractive, fresh: bool = False) -> DataFrame:
    """(qid, answer, cached): stored answers, and new ones for the rest, which are stored too. The index is built if one is missing."""
    keyed = questions.withColumn("key", cache_key(F.col("qtext"), *key_columns(config)))
    known = stored(cached_answers(questions.sparkSession, path), "answers")
    missing = stored(keyed if fresh else keyed.join(known, "key", "left_anti"), "misses")
    hits = keyed.join(known, "key") if not fresh else None
    if missing.isEmpty():
        return keyed.join(known, "key").select("qid", "answer", F.lit(True).alias("cached"))
    new = answered(None if config.no_rag else build(), missing.drop("key"), config, generate).join(missing.select("qid", "key"), "qid")
    new = stored(new.select("qid", "key", "answer"), "new-answers")
    cache_answers(new, path)
    new = new.select("qid", "answer", F.lit(False).alias("cached"))
    return new if hits is None else hits.select("qid", "answer", F.lit(True).alias("cached")).unionByName(new)
