import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.operators import graph
from querent.operators.vector import exact_top_k


def made_up(spark, n=1500, dims=16, seed=3):
    own = np.random.default_rng(seed).standard_normal((n, dims))
    rows = [(k, v.tolist(), "x") for k, v in enumerate(own)] + [(n, None, "x"), (n + 1, [0.0] * dims, "x")]
    return own, spark.createDataFrame(rows, "id long, embedding array<double>, v string")


@pytest.fixture(scope="module")
def built(spark):
    own, vectors = made_up(spark)
    return own, vectors, graph.knn_graph(vectors, 10)


def test_neighbours_are_the_nearest(built):
    own, _, found = built
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -9)
    best = np.argsort(-scores, axis=1)[:, :10]
    rows = {r.id: r.near for r in found.select("id", "near").collect()}
    assert rows.keys() == {*range(1500), 1501}
    assert all(len(set(near)) == len(near) <= 20 and k not in near for k, near in rows.items())
    assert np.mean([len(set(best[k].tolist()) & set(rows[k])) / 10 for k in range(1500)]) > 0.95


def test_search_finds_what_an_exact_one_finds(built):
    _, vectors, found = built
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = exact_top_k(queries, vectors.where("id < 1500").select("id", "embedding"), 11).where("qid != id")
    truth = {}
    for r in exact.orderBy("qid", "rank").collect():
        truth.setdefault(r.qid, []).append((r.id, r.score))
    result = graph.graph_top_k(queries, found, 10, apart=True)
    hits = {}
    for r in result.hits.orderBy("qid", "rank").collect():
        hits.setdefault(r.qid, []).append((r.id, r.score))
    assert hits.keys() == truth.keys() and all(len(h) == 10 and h == sorted(h, key=lambda x: (-x[1], x[0])) for h in hits.values())
    scores = {q: dict(t) for q, t in truth.items()}
    assert np.mean([len({i for i, _ in hits[q]} & set(list(scores[q])[:10])) / 10 for q in truth]) >= 0.9
    assert all(abs(scores[q][i] - s) < 1e-6 for q, h in hits.items() for i, s in h if i in scores[q])
    assert 0 < result.looked < 0.5
    whole = graph.graph_top_k(queries, found, 10, width=2000, apart=True)
    assert whole.looked > 0.98
    assert np.mean([len({i for i, _ in truth[q][:10]} & {r.id for r in whole.hits.where(F.col("qid") == q).collect()}) / 10 for q in list(truth)[:3]]) == 1.0


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    found = graph.knn_graph(empty)
    assert found.count() == 0
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, qvec array<double>")
    assert graph.graph_top_k(queries, found, 3).hits.collect() == []
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], empty.schema)
    hits = graph.graph_top_k(queries, graph.knn_graph(few, 3), 3).hits.orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in hits] == [(1, 1, 1.0), (1, 4, 1.0), (1, 3, 0.707107)]


def test_shards_are_searched_in_one_job_each(spark):
    """Several shards give what an exact search gives, and the jobs of a search don't grow with its width."""
    _, vectors = made_up(spark)
    found = graph.knn_graph(vectors, 10, shard_rows=400)
    assert {r.shard for r in found.select("shard").distinct().collect()} == {0, 1, 2, 3}
    queries = vectors.where("id % 50 = 0 AND id < 1500").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = exact_top_k(queries, vectors.select("id", "embedding"), 11).where("qid != id").collect()
    truth = {}
    for r in sorted(exact, key=lambda r: r.rank):
        truth.setdefault(r.qid, []).append(r.id)
    hits = {}
    for r in graph.graph_top_k(queries, found, 10, apart=True).hits.collect():
        hits.setdefault(r.qid, set()).add(r.id)
    assert np.mean([len(hits[q] & set(t[:10])) / 10 for q, t in truth.items()]) >= 0.9
    jobs = []
    for width in (20, 300):
        spark.sparkContext.setJobGroup(f"width-{width}", "a search")
        result = graph.graph_top_k(queries, found, 10, width=width, apart=True)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"width-{width}")))
        assert result.width == width and result.hits.count() == 300
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
