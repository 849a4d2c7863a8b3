import pytest

from querent.plans import sweeps
from querent.plans.config import Config
from querent.sources import synthetic

TEXTS = ["Cats are small animals.", "Dogs are loyal animals.", "Neural networks learn features.", "Gradient descent trains neural networks."]


def test_qa_report(spark):
    chunks = spark.createDataFrame([(k, t, "s") for k, t in enumerate(TEXTS)], "id long, text string, source string")
    rows = [(1, "which networks learn", "features", [["features"]]), (2, "loyal dogs are", "cats", [["dogs", "cats"], ["loyal"]]), (3, "unscored", "x", [])]
    questions = spark.createDataFrame(rows, "qid long, qtext string, expected string, keywords array<array<string>>")
    configs = {"bm25": Config(retriever="bm25", top_k=2), "none": Config(no_rag=True)}
    report = sweeps.qa_report(chunks, questions, configs)
    assert report.count() == 4
    got = {r.config: r for r in sweeps.qa_accuracy(report).collect()}
    assert got["bm25"].accuracy == 1.0 and got["bm25"].judge_accuracy == 0.5 and got["bm25"].disagreements == 1
    assert got["none"].accuracy == 0.0 and got["none"].n == 2


def test_ranking_runs(spark):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    queries = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[3]), (3, "unjudged")], "qid long, qtext string")
    qrels = spark.createDataFrame([(1, 0, 1), (2, 3, 1)], "qid long, id long, rel int")
    for r in sweeps.ranking_runs(corpus, queries, qrels, depth=3).collect():
        assert r.queries == 2 and r.ndcg_1 == r.rr == r.recall == 1.0


def test_scale_cells(spark):
    rows = {r.backend: r for r in sweeps.scale_cells(spark, [200], size=16, queries=2, k=5).collect()}
    assert rows["numpy"].recall_at_k == 1.0 and rows["numpy"].nprobe is None
    assert rows["faiss-ivf"].nprobe == 16 and 0.5 <= rows["faiss-ivf"].recall_at_k <= 1.0
    assert rows["faiss-flat"].recall_at_k == 1.0 and rows["qdrant"].recall_at_k >= 0.8
    assert all(r.latency_p50_ms <= r.latency_p95_ms for r in rows.values())
    with pytest.raises(ValueError):
        sweeps.scale_cells(spark, [10], ["other"])


def test_made_up_rows_do_not_depend_on_partitions(spark):
    a = {r.id: r.embedding for r in synthetic.vectors(spark, 20, 4).collect()}
    b = {r.id: r.embedding for r in synthetic.vectors(spark, 20, 4).coalesce(1).collect()}
    assert a == b and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in a.values())
    assert [tuple(r) for r in synthetic.documents(spark, 2).collect()] == [(0, "0", "synthetic"), (1, "1", "synthetic")]
