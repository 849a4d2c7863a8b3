import public_tokenizers
import pytest
from pyspark.sql import functions as F

from querent.functions import tables
from querent.operators.chunking import token_chunks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    tables.registered(spark, PATH)
    texts = ["One sentence. Another one follows here. " * 30, None, "", "  ", "# Head\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nProse after it.", "word " * 400]
    return spark.createDataFrame([(k, t, f"s{k % 2}", 7) for k, t in enumerate(texts)], "doc_id long, text string, source string, pos int")


def test_lateral_gives_the_chunks_of_the_operator(spark, docs):
    got = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL chunk_text(d.text, 64, 16) c", d=docs).collect()
    want = token_chunks(docs, PATH, 64, 16).select("doc_id", "pos", "text", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 10
    assert spark.sql("SELECT * FROM chunk_text('Just this.')").collect()[0].chunk == "Just this."


def test_tables_in_partitions(spark, docs):
    docs.createOrReplaceTempView("chunk_rows")
    got = spark.sql("SELECT * FROM chunk_table(TABLE(chunk_rows) PARTITION BY (source), 64, 16)")
    assert got.columns == ["doc_id", "source", "pos", "chunk", "n_tokens"]
    want = token_chunks(docs, PATH, 64, 16).select("doc_id", "source", "pos", "text", "n_tokens").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    spark.createDataFrame([], docs.schema).createOrReplaceTempView("no_rows")
    assert spark.sql("SELECT * FROM chunk_table(TABLE(no_rows) PARTITION BY source)").collect() == []


def test_errors_when_analysed(spark, docs):
    docs.select("doc_id").createOrReplaceTempView("no_text")
    for query in ("SELECT * FROM chunk_table(TABLE(no_text))", "SELECT * FROM chunk_text(5)", "SELECT * FROM chunk_text('a', 0)"):
        with pytest.raises(Exception, match="chunked|budget"):
            spark.sql(query)
    assert docs.where(F.col("text").isNull()).count() == 1
