import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.functions.vectors import embedded, hash_embed, normalised
from querent.operators import evaluation, fusion, lexical, vector
from querent.plans import search_queries

TEXTS = ["cats are small animals", "dogs are loyal animals", "neural networks learn features", "gradient descent trains neural networks", "cats and dogs live together"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(k, t, f"{'abcde'[k]}.txt") for k, t in enumerate(TEXTS)], "id long, text string, source string")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(k, [float(j == k) for j in range(8)], f"{'abcde'[k]}.pdf") for k in range(5)], "id long, embedding array<float>, source string")


def one(spark, q, row):
    return spark.createDataFrame([(q, [float(j == row) for j in range(8)])], "qid long, qvec array<float>")


def test_identity_vectors(spark, vectors):
    hits = vector.exact_top_k(one(spark, 1, 2), vectors, 3).orderBy("rank").collect()
    assert [r.id for r in hits] == [2, 0, 1] and hits[0].score == 1.0
    assert [r.id for r in vector.exact_top_k(one(spark, 1, 2), vectors, 9).orderBy("rank").collect()] == [2, 0, 1, 3, 4]


def test_source_filters(spark, vectors):
    allowed = {1: {"a.pdf", "e.pdf"}}
    assert {r.id for r in vector.exact_top_k(one(spark, 1, 2), vectors, 3, allowed).collect()} == {0, 4}
    assert vector.exact_top_k(one(spark, 1, 2), vectors, 3, {1: set()}).collect() == []


def test_blocks_of_queries_give_the_same_hits(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    rows = [(k, rnd.normal(size=8).tolist()) for k in range(90)] + [(90, None), (91, [0.0] * 8)]
    own = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(k, v) for k, v in rows[:20]], "qid long, qvec array<double>")
    whole = sorted(map(tuple, vector.exact_top_k(queries, own, 5).collect()))
    monkeypatch.setattr(vector, "QUERY_BYTES", 6 * 8 * 12)
    assert sorted(map(tuple, vector.exact_top_k(queries, own, 5).collect())) == whole
    for r in whole:
        assert -1 <= r[2] <= 1


def test_cells_and_hashing_reach_most_hits(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 16)) * 3
    rows = [(k, (centres[k % 12] + rnd.normal(size=16)).tolist()) for k in range(900)]
    own = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:40], "qid long, qvec array<double>")
    exact = vector.exact_top_k(queries, own, 10)
    centroids = vector.trained_centroids(own, vector.cell_count(900))
    found = vector.ivf_top_k(queries, vector.assigned(own, centroids), centroids, 10)
    for hits in (found, vector.lsh_top_k(queries, own, 10)):
        assert vector.recall(hits, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    few = vector.ivf_top_k(queries, vector.assigned(own, centroids), centroids, 10, probes=1)
    assert 0 <= vector.recall(few, exact, 10).agg(F.avg("recall")).first()[0] <= 1


def test_crowded_cells_are_dealt_without_losing_a_pair(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(k, rnd.normal(size=8).tolist(), 0 if k % 3 else k % 7) for k in range(300)]
    own = spark.createDataFrame([*rows, (300, rows[0][1], 0), (301, [0.0] * 8, 0)], "id long, embedding array<double>, cell_id int")
    queries = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows[:50])], "qid long, qvec array<double>")
    centroids = spark.createDataFrame([(k, rnd.normal(size=8).tolist()) for k in range(7)], "cell_id int, centre array<double>")
    whole = sorted(map(tuple, vector.exact_top_k(queries, own, 5).select("qid", "id", "score", "rank").collect()))
    for most in (vector.CELL_VECTORS, 40):
        monkeypatch.setattr(vector, "CELL_VECTORS", most)
        monkeypatch.setattr(vector, "CELL_QUERIES", most // 4)
        assert sorted(map(tuple, vector.ivf_top_k(queries, own, centroids, 5, probes=7).select("qid", "id", "score", "rank").collect())) == whole
        assert sorted(map(tuple, vector.lsh_top_k(queries, own, 5, vector.Hashing(bits=2, flips=2, tables=3)).select("qid", "id", "score", "rank").collect())) == whole
    assert not vector.ivf_top_k(queries.limit(0), own, centroids, 5).collect() and not vector.lsh_top_k(queries, own.limit(0), 5).collect()


def test_hashing_follows_the_number_of_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    own = spark.createDataFrame([(k, rnd.normal(size=8).tolist()) for k in range(600)], "id long, embedding array<double>")
    assert vector.fitted_hashing(own, 5).bits == 6
    monkeypatch.setattr(vector, "BUCKET_VECTORS", 2)
    wide = vector.fitted_hashing(own, 5)
    assert wide.bits == 9
    queries = own.selectExpr("id AS qid", "embedding AS qvec")
    assert vector.recall(vector.lsh_top_k(queries, own, 5, wide), vector.exact_top_k(queries, own, 5), 5).agg(F.avg("recall")).first()[0] >= 0.9


def test_normalised_keeps_zero(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>").select(normalised(F.col("a")), normalised(F.col("b"))).first()
    assert row[0] == [0.6, 0.8] and row[1] == [0.0, 0.0]


def test_embedder(spark, chunks):
    out = embedded(chunks, embed=hash_embed).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 and len(r.embedding) == 64 for r in out)
    assert embedded(chunks.limit(0)).collect() == []
    assert embedded(spark.createDataFrame([(None,)], "text string")).first().embedding == [0.0] * 64


def okapi(texts, query):
    """The scores of a text-book implementation."""
    docs = [t.lower().split() for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query.lower().split()) for d in docs]


@pytest.mark.parametrize("texts,query", [(TEXTS, "cats cats and NEURAL zebra"), (TEXTS, "zebra"), (TEXTS, ""), (["a b", "a b", "a c", ""], "a b c"), (["a", "a", "a b"], "a")])
def test_bm25_scores_and_zero_candidates(spark, texts, query):
    own = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "id long, text string, source string")
    got = lexical.top_k(spark.createDataFrame([(7, query)], "qid long, qtext string"), lexical.indexed(own), 4).orderBy("rank").collect()
    want = sorted(enumerate(round(s, 6) for s in okapi(texts, query)), key=lambda x: (-x[1], x[0]))[:4]
    assert [r.id for r in got] == [k for k, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_bm25_filter_keeps_the_statistics(spark, chunks):
    queries = spark.createDataFrame([(1, "cats animals"), (2, "zebra")], "qid long, qtext string")
    allowed = spark.createDataFrame([(1, "a.txt"), (1, "b.txt"), (2, "c.txt")], "qid long, source string")
    index = lexical.indexed(chunks)
    whole = {(r.qid, r.id): r.score for r in lexical.top_k(queries, index, 5).collect()}
    own = lexical.top_k(queries, index, 5, allowed).collect()
    assert {(r.qid, r.id) for r in own} == {(1, 0), (1, 1), (2, 2)}
    assert all(r.score == whole[r.qid, r.id] for r in own)


def lists(spark, dense, words):
    frame = lambda rows: spark.createDataFrame([(1, k, t, s, sc, k + 1) for k, (t, s, sc) in enumerate(rows)], "qid long, id long, text string, source string, score double, rank int")
    return frame(dense), frame(words)


def test_rrf_is_keyed_by_text(spark):
    dense, words = lists(spark, [("x", "a", 0.9), ("y", "b", 0.8), ("x", "c", 0.7)], [("y", "d", 5.0), ("z", "e", 4.0)])
    got = {r.text: r for r in fusion.rrf(dense, words, 10).collect()}
    assert got["x"].score == round(1 / 63, 6) and got["x"].source == "a"  # the last rank, the first source
    assert got["y"].score == round(1 / 62 + 1 / 61, 6) and got["y"].rank == 1
    swapped = {r.text: r.score for r in fusion.rrf(words, dense, 10).collect()}
    assert swapped == {t: r.score for t, r in got.items()}


def test_weighted_min_max(spark):
    dense, words = lists(spark, [("x", "a", 0.9), ("y", "b", 0.5)], [("y", "b", 3.0), ("z", "c", 3.0)])
    got = {r.text: r.score for r in fusion.weighted(dense, words, 10, 0.7).collect()}
    assert got == {"x": 0.7, "y": 0.0, "z": 0.0}
    with pytest.raises(ValueError):
        fusion.fusion("other", dense, words, 3)


def test_rerank_replaces_scores(spark, chunks):
    hits = chunks.select(F.lit(1).alias("qid"), (F.col("id") + 1).alias("rank"), "text", "source", F.lit(0.5).alias("score"))
    got = fusion.reranked(hits, spark.createDataFrame([(1, "neural networks learn")], "qid long, qtext string"), 3).orderBy("rank").collect()
    assert [r.text for r in got][:2] == [TEXTS[2], TEXTS[3]] and got[0].score == 1.0 and len(got) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(0, 5)), max_size=60, unique_by=lambda x: x[:2]), st.integers(1, 5), st.integers(1, 20))
def test_best_is_a_sorted_head_of_each_query(rows, k, limit):
    best = vector.Best(4, k)
    best.limit = limit
    for at in range(0, len(rows), 7):
        part = np.array(rows[at : at + 7], np.int64)
        fits = part[:, 2] >= best.floor[part[:, 0]]
        best.add(part[fits, 0], part[fits, 1], part[fits, 2].astype(float))
    query, ids, scores = best.settle()
    want = [x for q in range(4) for x in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:k]]
    assert list(zip(query.tolist(), ids.tolist(), scores.tolist(), strict=True)) == [(q, i, float(x)) for q, i, x in want]


def test_metrics_of_known_runs(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1), ("q2", "d3", 2), ("q3", "d9", 0)], "qid string, id string, rel int")
    run = spark.createDataFrame([("q1", "d1", 0.9), ("q2", "d3", 0.9), ("q2", "d2", 0.5), ("q2", "d7", 0.1), ("q3", "d1", 0.3), ("q4", "d1", 0.3)], "qid string, id string, score double")
    got = {r.qid: r for r in evaluation.ir_metrics(*evaluation.judged(run, qrels)).collect()}
    assert set(got) == {"q1", "q2", "q3"}
    assert got["q1"].ndcg_10 == got["q1"].rr == got["q1"].ap == got["q1"].recall == 1.0
    assert got["q2"].ndcg_10 == pytest.approx(1.0) and got["q2"].ap == 1.0
    assert got["q3"].recall == got["q3"].ap == got["q3"].rr == got["q3"].ndcg_1 == 0.0
    half = evaluation.ir_metrics(*evaluation.judged(run.where("id != 'd2'"), qrels)).where("qid = 'q2'").first()
    assert half.recall == 0.5
    tied = spark.createDataFrame([("q1", "d1", 0.5), ("q1", "d5", 0.5)], run.schema)
    assert evaluation.ir_metrics(*evaluation.judged(tied, qrels)).first().rr == 0.5  # ties by falling id
    assert evaluation.macro(evaluation.ir_metrics(*evaluation.judged(run, qrels))).first().queries == 3


def test_accuracy_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([], "right boolean, judge boolean")
    assert tuple(evaluation.accuracy(rows).first()) == (0, 0.0, 0.0, 0)


def test_random_orders_do_not_change_hits(spark, chunks):
    rows = list(enumerate(TEXTS)) * 1
    random.Random(1).shuffle(rows)
    other = spark.createDataFrame([(k, t, f"{'abcde'[k]}.txt") for k, t in rows], chunks.schema)
    queries = spark.createDataFrame([(1, "cats networks")], "qid long, qtext string")
    a, b = (sorted(map(tuple, lexical.top_k(queries, lexical.indexed(c), 5).collect())) for c in (chunks, other))
    assert a == b


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
@pytest.mark.parametrize("name", ["lsh_recall", "ivf_kmeans_recall", "recall_at_k"])
def test_index_recall_on_the_given_embeddings(spark, name):
    got = search_queries.QUERIES[name](spark, "/root/testdata/sf0.1").agg(F.avg("recall")).first()[0]
    print(name, got)
    assert got >= 0.9


def test_vectors_of_counted_words_are_those_of_texts(spark):
    from querent.functions.vectors import embedded, words_embedded
    from querent.operators import lexical

    texts = ["One two two", "", None, "ärger  one\tÖL\n", "x " * 500 + "y"]
    chunks = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "id long, text string, source string")
    want = {r.id: r.embedding for r in embedded(chunks.select("id", "text")).collect()}
    assert {r.id: r.embedding for r in words_embedded(lexical.indexed(chunks).chunks).collect()} == want
    assert words_embedded(lexical.indexed(chunks.limit(0)).chunks).collect() == []


class Caught:
    """Stands for a table whose row function is to be called by hand."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_words_are_counted_in_slices(spark):
    """A batch of long texts isn't held as words all at once."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(64)), "text": [f"w{k} " * 100_000 for k in range(64)], "source": ["s"] * 64})
    parts = list(lexical.counted(Caught())(iter([batch])))
    assert max(p.num_rows for p in parts) <= 8 and [i for p in parts for i in p.column("id").to_pylist()] == list(range(64))
    assert all(c == [100_000] for p in parts for c in p.column("counts").to_pylist())
