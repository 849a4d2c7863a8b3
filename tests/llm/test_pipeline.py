import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from querent.llm import pii, simhash, toxicity
from test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    docs, labels = corpus(2, 300)
    rows = [(k, t + (f" write to a{k}@b.co or +1 (456) 555-{k:04}" if k % 9 == 0 else ""), "en", rnd.choice(["a", "b", None, "hot", "hot"]), len(t)) for k, t, _, _ in docs]
    rows += [(1000 + k, rows[k][1], "en", "copies", 9) for k in range(0, 200, 3)]
    rows += [(None, rows[5][1], "fr", "x", 1), (None, "a text of null ids only", "fr", "x", 2), (None, "a text of null ids only", "fr", "y", 2), (2000, None, None, None, None), (2001, "", "de", "x", 0), (7, rows[7][1], "en", "z", 3)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def alike(rows, similarity=0.8, width=5):
    """The groups of rows that pairs of texts connect whose sets of five-word shingles are as similar as that, over all pairs."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, bool(words))))

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def first(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if first(i) != first(k) and (a == b or len(a & b) >= similarity * len(a | b) - 1e-9):
                root[first(i)] = first(k)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(first(k), []).append(r)
    return groups


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
        assert out[-1].columns == docs.columns or name == "bpe"
    rows = [[tuple(r) for r in df.collect()] for df in out]

    model = toxicity.trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r for r, s in zip(rows[0], model.scores([r[1] for r in rows[0]]), strict=True) if s < 0.5]
    assert Counter(rows[1]) == Counter(want) and len(want) < len(rows[0])

    groups = alike(rows[1])
    ids = [min((r[0] is None, r[0]) for r in g) for g in groups.values()]
    assert sorted((r[0] is None, r[0]) for r in rows[2]) == sorted(ids)
    assert all(r in rows[1] for r in rows[2])

    finder = pii.trained(out[2])
    blank = lambda t: pii.blanked(t, finder.found([t])[0][1])
    assert sorted(map(repr, rows[3])) == sorted(repr((i, None if t is None else blank(t), la, s, n if t is None else len(blank(t)))) for i, t, la, s, n in rows[2])
    assert not any("@b.co" in (r[1] or "") or "555-" in (r[1] or "") for r in rows[3])

    words = lambda rs: Counter({s: sum(len((r[1] or "").split()) for r in rs if r[3] == s) for s in {r[3] for r in rs}})
    assert all(n <= 2 for n in Counter(map(repr, rows[4])).values())
    before, after = words(rows[3]), words(rows[4])
    longest = max(len((r[1] or "").split()) for r in rows[3])
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= longest * len(before)
    assert all(after[s] <= 2 * before[s] for s in before)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in out[5].collect()) == sorted((i is None, i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows[4])

    run = corpus_pipeline.run(spark, folder)
    assert Counter(map(repr, run.collect())) == Counter(map(repr, out[5].collect()))


def test_unique_ids_take_the_plain_join(spark):
    docs = spark.createDataFrame([(3, "same words here", "x"), (1, "same words here", "y"), (2, "other", "z")], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.kept(docs).collect())) == [(1, "same words here", "y"), (2, "other", "z")]
    assert simhash.kept(docs.limit(0)).collect() == []
    for ids in ((1, 2, 3), (1, 1, None)):
        clash = spark.createDataFrame([(i, t, 5, 6, 7, 8) for i, t in zip(ids, ["same words here", "same words here", "other"], strict=True)], "doc_id long, text string, simhash_id int, Simhash_of int, simhash_fp int, simhash_copy int")
        assert simhash.kept(clash).columns == clash.columns and simhash.kept(clash).count() == 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_long_texts_clashing_names_and_repeated_rows(spark, tmp_path):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [prose(60) for _ in range(30)] + [prose(200_000), None, "", "x" * 300_000]
    rows = [(k, t, "en", None if k % 3 else "s", 0, 1, 2.0, 3, "f", 4, "v") for k, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, simhash_id int, Score double, mix_times int, fp string, place int, spans string"
    spark.createDataFrame(rows + rows[:5] + rows[:5], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k == 1)) for k in range(20)] + [(999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == before.columns, name
        if name == "simhash_near_dedup":
            ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
            assert len(ids) == len(set(ids)) and {0, 30, 31, 33} <= set(ids) and 32 not in ids
    got = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()} and all(len(r.ids) == r.n_tokens for r in got)


def test_without_labels_all_documents_stay(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(4)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.not_toxic(spark, docs, str(tmp_path)).count() == 4
