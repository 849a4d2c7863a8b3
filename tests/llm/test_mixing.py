import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from querent.llm import mixing


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    sources = ["b", "a", None, "é", "z", "Z", "", "hot"]
    out = [(k, rnd.choice(sources + ["hot"] * 4), " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice([0, 1, 5, 40, 900])))) for k in range(n)]
    out += [(None, "a", None), (None, "a", "two words"), (3, "none", None), (4, "none", ""), (5, "one", "a b\tc\n d"), (7, "twice", "x y z"), (7, "twice", "x y z"), (8, "nbsp", "a b　c\x0bd")]
    return out


def levels(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """Clamp and share again, source by source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > epochs * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())


def docs(spark, data):
    return spark.createDataFrame([(d, s, t, 1.5) for d, s, t in data], "doc_id long, source string, text string, target double")


def test_targets_and_words(spark):
    data = rows()
    got = mixing.mixed(docs(spark, data)).collect()
    assert len(got) == len(data)
    size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
    assert sorted(r.size for r in got) == sorted(size(t) for _, _, t in data)
    sizes, taken = {}, {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = levels(sizes)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
    for s, words in taken.items():
        assert abs(words - want[s]) < 1.0001


def test_sql_gives_the_same_rows(spark):
    documents = pd.DataFrame(rows(2), columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(mixing.SQL.format(documents="documents")).fetchall()
    got = mixing.mixed(docs(spark, rows(2))).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_repeated_rows_follow_the_plan(spark):
    data = [(k, s, t) for k, (_, s, t) in enumerate(rows(3))]
    df = docs(spark, data)
    times = {}
    for r in mixing.repeated(df).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert (r.source, r.text, r.target) == (*data[r.doc_id][1:], 1.5)
    for r in mixing.mixed(df).collect():
        if r.size:
            assert times.get(r.doc_id, 0) == r.whole + (2 * r.part >= r.size and r.part > 0)


def test_reruns_agree_whatever_the_partitions(spark):
    df = docs(spark, rows(4))
    a, b = (sorted(map(repr, mixing.mixed(x).collect())) for x in (df.repartition(7), df.coalesce(1)))
    assert a == b
    c = sorted(map(repr, mixing.mixed(df, seed=7).collect()))
    assert c != a


def test_edges(spark):
    assert mixing.mixed(docs(spark, [])).collect() == []
    assert mixing.repeated(docs(spark, [])).collect() == []
    only = mixing.mixed(docs(spark, [(1, None, None), (2, None, "")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in only] == [(0, 0, 0.0, 0)] * 2


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x y z", 1, 2, 3), (2, "b", "u", 4, 5, 6)], "doc_id long, source string, text string, place int, mix_size int, Mix_Times int")
    got = mixing.repeated(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}


def test_texts_without_words_are_repeated_like_others(spark):
    rows = [(k, "w " * 10, "a") for k in range(20)] + [(100 + k, "", "a") for k in range(20)] + [(200 + k, None, "z") for k in range(5)] + [(300, "x y", "b")]
    got = mixing.repeated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    times = Counter(r.doc_id for r in got)
    assert sum(times[k] for k in range(20)) == 30 and all(times[k] in (1, 2) for k in [*range(20), *range(100, 120)])
    assert [times[k] for k in (*range(200, 205), 300)] == [1, 1, 1, 1, 1, 2]
