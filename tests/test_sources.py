import io
import zipfile

import pytest
from pyspark.sql import functions as F

from querent.sources import files, stores

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
MD = "# Notes\n\nProse.\n| Model | NQ |\n|---|---|\n| A | 41.5 |\n| B | 44.5 |\n"


def docx(body, styles=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def par(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    (path / "note.txt").write_text("  one note\n\n", encoding="utf-8")
    (path / "blank.txt").write_text(" \n\t ", encoding="utf-8")
    (path / "a.md").write_text(MD, encoding="utf-8")
    (path / "ignore.csv").write_text("x,y", encoding="utf-8")
    table = "<w:tbl><w:tr><w:tc>" + par("h") + "</w:tc><w:tc>" + par("v") + "</w:tc></w:tr><w:tr><w:tc>" + par("a") + par("b") + "</w:tc><w:tc>" + par("1") + "</w:tc></w:tr></w:tbl>"
    (path / "d.docx").write_bytes(docx(par("Top", "H1") + par("  ") + par("Body é") + table + par("Big", "Title")))
    (path / "broken.docx").write_bytes(b"no zip")
    return str(path)


def test_readers(spark, folder):
    assert [tuple(r) for r in files.read_text(spark, folder).collect()] == [("one note", "note.txt")]
    got = {r.text for r in files.read_markdown(spark, folder).collect()}
    assert got == {MD.strip(), "Notes A: NQ 41.5.".replace("NQ 41.5", "NaturalQuestions NQ 41.5"), "Notes B: NaturalQuestions NQ 44.5.", "Notes NaturalQuestions NQ: A 41.5, B 44.5."}
    assert [tuple(r) for r in files.read_docx(spark, folder).collect()] == [("## Top\nBody é\n| h | v |\n| --- | --- |\n| a b | 1 |\n## Big", "d.docx")]
    faults = {r.source: r.error for r in files.read_docx(spark, folder, errors=True).collect()}
    assert faults["d.docx"] is None and "BadZipFile" in faults["broken.docx"]
    whole = files.read_documents(spark, folder)
    assert {(r.src_order, r.source) for r in whole.collect()} == {(1, "a.md"), (2, "note.txt"), (3, "d.docx")}
    assert [r.source for r in files.source_names(spark, folder).collect()] == ["a.md", "blank.txt", "broken.docx", "d.docx", "note.txt"]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "text": "y"}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    assert {tuple(r) for r in files.read_corpus(spark, f"{tmp_path}/corpus.jsonl").collect()} == {("d1", "T x"), ("d2", "y")}
    qrels = files.read_qrels(spark, f"{tmp_path}/qrels.tsv")
    assert [tuple(r) for r in qrels.collect()] == [("q1", "d1", 1)]
    queries = spark.createDataFrame([("q1", "a"), ("q2", "b")], "qid string, qtext string")
    assert [r.qid for r in files.judged_only(queries, qrels).collect()] == ["q1"]


def test_chunk_store(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    chunks = spark.createDataFrame([(2, "b", "y"), (1, "a", "x")], "id long, text string, source string")
    assert not stores.exists(spark, path)
    stores.save_chunks(chunks, path)
    assert [tuple(r) for r in stores.load_chunks(spark, path).collect()] == [(1, "a", "x"), (2, "b", "y")]
    stores.add_chunks(spark, spark.createDataFrame([(3, "c", "x"), (4, "a", "x")], chunks.schema), path)
    assert [r.text for r in stores.load_chunks(spark, path).collect()] == ["a", "b", "c"]
    stores.save_chunks(chunks.limit(0), path)
    assert not stores.exists(spark, path)
    stores.invalidate(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_built_once_by_configuration(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(6).withColumn("cell_id", F.col("id") % 2)

    a = stores.cache_path(str(tmp_path), "cells", {"embed_model": "BAAI/bge-small", "chunk_max_tokens": 64, "index_type": "ivf"})
    b = stores.cache_path(str(tmp_path), "cells", {"embed_model": "BAAI/bge-small", "chunk_max_tokens": 64, "index_type": "flat"})
    assert a != b and "BAAI-bge-small-64" in a
    for _ in range(2):
        assert stores.loaded_or_built(spark, a, build, by="cell_id").where("cell_id = 1").count() == 3
    assert len(calls) == 1


def test_answers_and_runs(spark, tmp_path):
    path = f"{tmp_path}/answers"
    assert stores.cached_answers(spark, path).collect() == []
    stores.cache_answers(spark.createDataFrame([("k", "old"), ("j", "x")], "key string, answer string"), path)
    stores.cache_answers(spark.createDataFrame([("k", "new")], "key string, answer string"), path)
    assert {tuple(r) for r in stores.cached_answers(spark, path).collect()} == {("k", "new"), ("j", "x")}
    runs = f"{tmp_path}/runs"
    for name, score in (("a", 0.5), ("b", 0.7), ("a", 0.9)):
        stores.log_run(spark, runs, "qa", name, {"k": 3}, {"accuracy": score})
    stores.log_run(spark, runs, "other", "c", {}, {"accuracy": 1.0})
    assert [(r.run_name, r.metrics["accuracy"]) for r in stores.runs(spark, runs, "qa").collect()] == [("a", 0.9), ("b", 0.7)]
