import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.llm import langid, queries

MASK = (1 << 64) - 1


def bucket(gram, bits):
    rolled = 0
    for c in gram:
        rolled = (rolled * int(langid.FACTORS[0]) + ord(c)) & MASK
    mixed = ((rolled + int(langid.FACTORS[1]) * len(gram)) & MASK) * int(langid.FACTORS[2]) & MASK
    return ((mixed ^ (mixed >> 29)) * int(langid.FACTORS[0]) & MASK) >> (64 - bits)


def plain_counts(text, bits):
    marked = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    joined = " " + " ".join(marked.split(" ")) + " "
    while "  " in joined:
        joined = joined.replace("  ", " ")
    return Counter(bucket(joined[at : at + n], bits) for n in (1, 2, 3) for at in range(len(joined) - n + 1))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZé ß1.\n日́", max_size=40), st.integers(1, 7))
def test_counts_in_blocks(text, block):
    total = langid.counts(text, 12, block)
    assert {k: int(n) for k, n in enumerate(total) if n} == (plain_counts(text, 12) if text else {bucket(" ", 12): 1})


def plain_model(rows, bits):
    learned = [(lang, text) for d, lang, text in rows if lang is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 3 != 1]
    names = sorted({lang for lang, _ in learned})
    grams = {n: Counter() for n in names}
    for lang, text in learned:
        if text is not None and any(c.isalpha() for c in text):
            grams[lang] += plain_counts(text, bits)
    share = Counter(lang for lang, _ in learned)
    return names, grams, share


def plain_scores(model, text, bits):
    names, grams, share = model
    own = plain_counts(text, bits)
    logs = [math.log(share[n] / sum(share.values())) + sum(k * float(np.float32(math.log((grams[n][b] + 0.5) / (grams[n].total() + 0.5 * 2**bits)))) for b, k in own.items()) for n in names]
    top = max(logs)
    return dict(zip(names, logs, strict=True)), 1 / sum(math.exp(x - top) for x in logs)


def test_against_brute_force(spark):
    texts = ["the cat sat on the mat", "der Hund liegt auf der Matte", "le chat est sur le tapis", "El gato, está!", None, "", "1234 ...", "日本語のテキスト", "the", "x" * 5000, "the cat sat on the mat"]
    langs = ["en", "de", "fr", "es", "en", None, "", "ja", "en"]
    rows = [(None if k == 40 else k, langs[k % len(langs)], texts[k % len(texts)], 7) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int")
    model = langid.trained(docs, bits=10)
    want = plain_model([r[:3] for r in rows], 10)
    assert model.languages == want[0] == ["", "de", "en", "es", "fr", "ja"]
    got = langid.identified(docs, model).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in rows)
    by_id = {r.doc_id: r for r in got}
    for d, _, text, _ in rows:
        own = by_id[d]
        assert own.held_out == (zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1)
        if text is None or not any(c.isalpha() for c in text):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        logs, chance = plain_scores(want, text, 10)
        assert logs[own.lang_pred] >= max(logs.values()) - 1e-6 and abs(own.score - chance) < 1e-6
    kept = langid.labelled(docs, model, "Score").columns
    assert kept == ["doc_id", "lang", "text", "score", "Score_"]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    model = langid.trained(empty)
    assert model.languages == [] and langid.identified(empty, model).collect() == []
    some = spark.createDataFrame([(1, None, "words"), (2, None, None)], empty.schema)
    assert {(r.lang_pred, r.score) for r in langid.identified(some, langid.trained(some)).collect()} == {("und", 0.0)}
    many = spark.range(langid.LANGUAGES + 2).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"), F.lit("a").alias("text"))
    with pytest.raises(ValueError, match="lang has more"):
        langid.trained(many, folds=1, fold=1)


def test_matrix_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 1 << 12)
    docs = spark.createDataFrame([(k, f"l{k % 40}", "abc " * k) for k in range(200)], "doc_id long, lang string, text string")
    assert langid.trained(docs).likely.size <= 1 << 12


def test_long_text(spark):
    model = langid.Model(["a", "b"], np.zeros((1 << 16, 2), np.float32), np.zeros(2))
    names, scores = model.predicted(["häßlich und schön " * 600_000])
    assert (names, scores) == (["a"], [0.5])


def test_held_out_accuracy(spark):
    rows = queries.op12_langid(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = rows.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert found[1] > 250 and found[0] > 0.97
