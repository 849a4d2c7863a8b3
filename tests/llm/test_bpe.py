import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querent.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def samples(seed=1):
    rnd = random.Random(seed)
    words = ["the", "Ärger", "l'été", "don't", "  ", "\n\n", "\t", "日本語", "🙂", "<|endoftext|>", "12345", "a" * 60, "!!!", " ", " ", "x.y", "'s", "<|endo", "ftext|>", "é", "\r\n"]
    out = ["", " ", "\n", None, "a" * 5000, " " * 3000, "é" * 2000, "<|endoftext|>" * 300, "1" * 4000, "日本語" * 900]
    for _ in range(60):
        out.append("".join(rnd.choice(words) + rnd.choice([" ", "", " ", "\n"]) for _ in range(rnd.randint(1, 900))))
    return out + out[20:40]


@pytest.mark.parametrize("chunking", [{}, {"window": 4, "mean_bits": 3}, {"window": 8, "mean_bits": 6, "longest": 40}])
def test_ids_and_text_are_those_of_the_library(chunking):
    own = bpe.ChunkedBpe(PATH, cache_bytes=1 << 18, **chunking)
    texts = samples()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False) == (text or "")
    assert own.held <= 1 << 18


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é\n'sd.1 <|>")), max_size=200))
def test_any_text_with_tiny_chunks(text):
    own = OWN
    assert own.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


OWN = bpe.ChunkedBpe(PATH, window=2, mean_bits=1)


def test_shared_passages_are_encoded_once():
    rnd = random.Random(3)
    passage = " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(4000))
    own = bpe.ChunkedBpe(PATH)
    own.encode([f"{k} own start {passage}" for k in range(20)])
    assert own.encoded_chunks < own.used_chunks / 5


def test_cuts_partition_the_text():
    for text in samples(4):
        data = (text or "").encode()
        ends = bpe.cuts(data, window=8, mean_bits=5, longest=64)
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] or not data)
        for a, b in zip([0, *ends], ends, strict=False):
            data[a:b].decode()
            assert b - a <= 64


def test_queries(spark):
    texts = samples(7)
    docs = spark.createDataFrame([(k, t, [1]) for k, t in enumerate([*texts, texts[3]])], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()}
    for k, t in enumerate([*texts, texts[3]]):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert back[k] == (t or "")
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_every_character_parts_words_as_in_the_library():
    own = bpe.ChunkedBpe(PATH)
    assert own.ranks is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or c > 0xE0000 and c < 0xE0200)]
    texts = ["".join(f"a{c}1 {c}{c}b! " for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    for text, ids in zip(texts, own.raw([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("run", "n"), [*((r, n) for r in (" ", "\n", " \n\t") for n in (4095, 4097, 300_001)), (" ", 10**7), ("\n", 10**7)])
def test_long_white_space_is_that_of_the_library(run, n):
    own = bpe.ChunkedBpe(PATH)
    run = (run * n)[:n]
    for text in (run, f"Some prose.{run}More of it.{run[:5000]}x"):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        ids = own.encode([text])[0]
        assert np.array_equal(ids, np.array(want, np.uint32)) and own.decode(ids) == text


def test_query_with_long_white_space(spark):
    texts = [" " * 10**6, "\n" * 10**6, f"Prose{' ' * 10**6}goes on.", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.digests(docs, PATH).collect():
        ids = LIBRARY.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
