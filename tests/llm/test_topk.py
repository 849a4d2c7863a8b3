import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import topk


def brute(rows, k=10, every=7):
    own = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in own:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def table(seed, n, size=12, spread=1.0):
    rnd = np.random.default_rng(seed)
    basis = rnd.normal(size=(size, size)) * np.geomspace(1, 0.05, size)[:, None]
    rows = [(int(k), [float(np.float32(x)) for x in v]) for k, v in enumerate((rnd.normal(size=(n, size)) @ basis) * np.exp(spread * rnd.normal(size=(n, 1))))]
    copies = [(n + k, rows[3][1]) for k in range(40)]
    return rows + copies


@pytest.mark.parametrize("spread", [0.0, 1.5])
@pytest.mark.parametrize("block,query_block", [(8192, 1024), (50, 9)])
def test_equals_all_pairs(spark, spread, block, query_block):
    rows = table(1, 400, spread=spread)
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (910, []), (911, [0.5, -0.25]), (14, rows[5][1]), (14, rows[14][1])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, norm string")
    got = topk.top_k(df, F.col("vec_id") % 7 == 0, block_rows=block, query_rows=query_block).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_more_queries_than_a_step(spark):
    """Blocks of the default size, whose queries are compared in steps."""
    v = np.random.default_rng(5).integers(-300, 300, size=(3000, 4))
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, k=3, scale=1).collect()
    scores = v @ v.T
    np.fill_diagonal(scores, -(2**60))
    best = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert topk.STEP < 1500
    assert sorted(map(tuple, got)) == [(q, r + 1, int(best[q, r]), int(scores[q, best[q, r]])) for q in range(0, 3000, 2) for r in range(3)]


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(7, [1.0, 2.0])], [(7, [1.0, 2.0]), (1, [0.5, 0.5]), (14, [-1.0, 0.0])], [(1, [1.0])], [(7, []), (8, [])]):
        got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 7 == 0).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_bounds_prune_and_lose_nothing(monkeypatch):
    rnd = np.random.default_rng(4)
    vectors = (rnd.normal(size=(5000, 32)) * np.geomspace(900, 1, 32) * np.exp(rnd.normal(size=(5000, 1)))).astype(np.int64)
    queries = vectors[:40]
    rotation = np.linalg.svd(vectors[:500].astype(float))[2].T
    tried = []
    add = topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, q, i, s: (tried.append(len(q)), add(self, q, i, s))[1])
    best = topk.searched(queries, np.arange(40), np.full(40, -(2**63)), vectors, np.arange(5000), rotation, 10)
    scores = queries @ vectors.T
    scores[np.arange(40), np.arange(40)] = -(2**62)
    for q in range(40):
        order = sorted(range(5000), key=lambda i: (-scores[q, i], i))[:10]
        assert best.ids[q].tolist() == order
    assert sum(tried) < 0.3 * 40 * 5000


def test_large_components_stay_whole(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.uniform(-1, 1) * 2.0**17 for _ in range(6)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 7 == 0).collect())) == brute(rows)
