import random
import zlib

import numpy as np
import pytest

from querent.llm import toxicity

WORDS = "river stone garden window evening market letter bridge winter teacher music paper kitchen station mountain".split()


def corpus(seed=1, n=600):
    """Rude sentences name a group more often than neutral ones do."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(6, 40))]
        if rnd.random() < (0.8 if toxic else 0.05):
            words.insert(rnd.randrange(len(words)), "gay" if rnd.random() < 0.9 else "straight")
        if toxic and rnd.random() < 0.9:
            words.insert(rnd.randrange(len(words)), rnd.choice(["grubworm", "Slimeball!"]))
        docs.append((k, " ".join(words), "en", 0.5))
        labels.append((k, 1 if rnd.random() < 0.5 else 0, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_rows(spark, tables):
    docs, labels = tables
    model = toxicity.trained(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    left = {r.doc_id for r in toxicity.kept(docs, model).collect()}
    assert left == {r.doc_id for r in got if not r.predicted}


def test_swaps_lower_the_weight_of_group_mentions(tables):
    docs, labels = tables
    free, tied = (toxicity.trained(docs, labels, penalty=p) for p in (0.0, 100.0))
    neutral = [f"the gay {a} by the {b}" for a in WORDS for b in WORDS]
    other = [t.replace("gay", "straight") for t in neutral]
    gap = lambda m: np.abs(m.scores(neutral) - m.scores(other)).mean()
    assert gap(tied) < gap(free) / 3
    assert (tied.scores(neutral) >= 0.5).mean() <= (free.scores(neutral) >= 0.5).mean()
    assert tied.scores(["you grubworm of the river"])[0] > tied.scores(["you garden of the river"])[0]


def test_swapper_turns_each_group_round():
    swap = toxicity.swapper(toxicity.IDENTITIES)
    assert swap("women and men, a womanly man") == "men and women, a womanly woman"
    for group in toxicity.IDENTITIES:
        text = group[0]
        for _ in group:
            text = swap(text)
        assert text == group[0]
    assert toxicity.swapper(())("women") == "women"


def test_terms_stand_in_one_group():
    terms = [t for g in toxicity.IDENTITIES for t in g]
    assert len(terms) == len(set(terms)) and all(t == t.lower() for t in terms)
    swap = toxicity.swapper(toxicity.IDENTITIES)
    assert swap("die frauen, les hommes et una mujer") == "die männer, les femmes et una hombre"


def test_counterfactuals_are_pairs_of_sentences(spark):
    texts = ["Women and men met. The river was cold! A muslim teacher", None, "", "no term here", "gay\nriver gay. " * 3]
    rows = spark.createDataFrame([(t, 1) for t in texts], "text string, toxic int")
    swap = toxicity.swapper(toxicity.IDENTITIES)
    pairs = [p for t in texts for p in toxicity.swapped_sentences(t, swap)]
    assert [p[0].strip() for p in pairs[:2]] == ["women and men met", "a muslim teacher"] and len(pairs) == 2 + 6
    index = (np.arange(1 << toxicity.BUCKET_BITS) % 97).astype(np.int32)
    want = np.zeros((97, 97))
    for own, other in pairs:
        a, b = ({int(index[g]) for g in toxicity.buckets(np.frombuffer(toxicity.plain(t), np.uint8)).tolist()} for t in (own, other))
        d = np.array([(k in a) - (k in b) for k in range(97)], float)
        want += np.outer(d, d)
    n, total = toxicity.counterfactuals(rows, index, 97, toxicity.IDENTITIES)
    assert n == len(pairs) and np.array_equal(total, want)


def test_scores_equal_plain_loops(tables):
    docs, labels = tables
    model = toxicity.trained(docs, labels)
    assert model.counterfactuals > 50
    for text in ["the gay slimeball of the river", "", None, "Evening\tletter  é", "grubworm " * 30]:
        data = b" " + "".join(" " if c in "\t\n\v\f\r\0" else c for c in (text or "").lower()).encode() + b" "
        found = set()
        for k in range(len(data) - 4):
            value = data[k]
            for byte in data[k + 1 : k + 5]:
                value = (value * 0x01000193 & 0xFFFFFFFF) ^ byte
            value = value * 0x9E3779B1 & 0xFFFFFFFF
            value = ((value ^ value >> 15) * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - toxicity.BUCKET_BITS)
            if model.index[value] >= 0:
                found.add(int(model.index[value]))
        margin = model.bias + sum(float(model.weights[f]) for f in found)
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_held_out_labels_are_not_used(spark, tables):
    docs, labels = tables
    turned = spark.createDataFrame([(k, 0, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, _, t in (tuple(r) for r in labels.collect())], labels.schema)
    a, b = (toxicity.trained(docs, x).scores(["a gay slimeball", "river"]) for x in (labels, turned))
    assert np.array_equal(a, b)


def test_features_are_distinct_grams_of_each_text(monkeypatch):
    texts = ["", None, "abc", "Hello  World\n", "é" * 50, "x" * 100, "hello world and more words " * 20]
    index = np.arange(1 << toxicity.BUCKET_BITS, dtype=np.int32)
    want = set()
    for k, t in enumerate(texts):
        data = toxicity.plain(t)
        want |= {(k, int(toxicity.buckets(np.frombuffer(data[i : i + 5], np.uint8))[0])) for i in range(len(data) - 4)}
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        rows, features = toxicity.gathered([toxicity.plain(t) for t in texts], index)
        assert set(zip(rows.tolist(), features.tolist(), strict=True)) == want and len(rows) == len(want)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, ""), (3, "grubworm " * 50_000)], "doc_id long, text string")
    for rows in ([], [(1, 0, 1), (2, 0, None), (None, 0, 1)], [(1, 0, 1), (1, 0, 0), (99, 0, 0), (2, 0, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        model = toxicity.trained(docs, labels)
        got = toxicity.scored(docs, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.scored(docs.limit(0), model).collect() == []
        assert toxicity.kept(docs.limit(0), model).collect() == []


def test_words_behind_a_long_prefix_are_learnt(spark):
    prefix = "a plain sentence about rivers " * 700  # 21,000 characters
    docs = [(k, prefix + ("grubworm slimeball" if k % 4 == 0 else "evening letter"), "en", 0.5) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    model = toxicity.trained(df, spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)], "doc_id long, quality int, toxic int"))
    assert {r.doc_id for r in toxicity.scored(df, model).collect() if r.predicted} == set(range(0, 80, 4))
