"""Chunk queries that SQL doesn't check, against plain loops over the smallest table."""

import hashlib
import os

import pytest

from querent.operators import sentences
from querent.operators.chunking import split_sentences
from querent.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_sentence_chunks_of_every_document(spark, texts):
    want = []
    for doc_id, text in texts.items():
        held, pos = [], 0
        for s in [*split_sentences(text or ""), None]:
            size = sum(map(len, held))
            if held and (s is None or size + len(s) > 500 and size >= 300):
                want.append((doc_id, pos, md5(" ".join(held))))
                held, pos = [], pos + 1
            held.append(s)
    got = registry.QUERIES["chunk_sentence"](spark, FOLDER).select("doc_id", "pos", "text").collect()
    assert sorted((r.doc_id, r.pos, md5(r.text)) for r in got) == sorted(want)


def test_the_table_function_gives_the_token_chunks(spark):
    chunks = registry.QUERIES["chunk_tokens"](spark, FOLDER).select("doc_id", "pos", "n_tokens", "text").collect()
    rows = registry.QUERIES["chunk_lateral"](spark, FOLDER).select("doc_id", "pos", "n_tokens", "text_md5").collect()
    assert sorted((*r[:3], md5(r.text)) for r in chunks) == sorted(map(tuple, rows)) and len(rows) > 200


def test_token_chunks_hold_every_sentence_in_order(spark, texts):
    """What stays of the chunks without their overlaps is the text: each sentence that fits a budget stands whole in a chunk, in order."""
    import public_tokenizers

    from querent.operators.chunking import TokenChunker, public_encoding, text_segments

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = sentences.trained(docs)
    e = public_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {}
    for r in registry.QUERIES["chunk_learned"](spark, FOLDER).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.text_md5, r.n_tokens))
    for doc_id, text in texts.items():
        chunks = TokenChunker(e.encode_ordinary, e.decode, 128, 50, model).chunks(text) if text else []
        assert got.get(doc_id, []) == [(md5(c), len(e.encode_ordinary(c))) for c in chunks]
        at = 0
        for kind, body in text_segments(text or ""):
            for s in model.split(body) if kind == "prose" else []:
                if len(e.encode_ordinary(s)) <= 128:
                    at = next(k for k in range(at, len(chunks)) if s in chunks[k])
