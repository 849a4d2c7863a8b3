import random

import pytest
from pyspark.sql import functions as F

from querent.sources import versions


def rows_of(df):
    return {r.id: r.text for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_versions_are_those_of_a_dictionary(spark, tmp_path):
    rnd = random.Random(3)
    store, held, seen = versions.KeyedStore(spark, f"{tmp_path}/s", "id"), {}, {}
    for step in range(12):
        keys = [rnd.choice([None, *range(25)]) for _ in range(rnd.randint(1, 12))]
        what = "put" if step == 0 else rnd.choice(["put", "put", "add", "delete", "compact"])
        if what in ("put", "add"):
            rows = {k: f"{k}-{step}" for k in keys}
            version = getattr(store, what)(table(spark, list(rows.items())))
            held = held | rows if what == "put" else rows | held
        elif what == "delete":
            version = store.delete(table(spark, [(k, None) for k in keys]))
            held = {k: v for k, v in held.items() if k not in keys}
        else:
            version = store.compact()
            assert len(version.segments) == 1
        assert version.number == step + 1
        seen[version.number] = held
    for number, want in seen.items():
        assert rows_of(store.read(number)) == want
    assert [h[0] for h in store.history()] == list(seen)


def test_a_reader_stays_on_its_version(spark, tmp_path):
    store = versions.KeyedStore(spark, f"{tmp_path}/s", "id")
    store.put(table(spark, [(1, "a"), (2, "b")]))
    opened = store.read()
    store.put(table(spark, [(1, "new")]))
    store.delete(table(spark, [(2, None)]))
    store.compact()
    assert rows_of(opened) == {1: "a", 2: "b"} and rows_of(store.read()) == {1: "new"}


def test_a_write_that_stops_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = versions.KeyedStore(spark, f"{tmp_path}/s", "id")
    store.put(table(spark, [(1, "a")]))
    with monkeypatch.context() as m:
        m.setattr(store, "committed", lambda version: (_ for _ in ()).throw(SystemError("killed")))
        for write in (lambda: store.put(table(spark, [(1, "b"), (3, "c")])), lambda: store.delete(table(spark, [(1, None)])), store.compact):
            with pytest.raises(SystemError):
                write()
    again = versions.KeyedStore(spark, f"{tmp_path}/s", "id")
    assert rows_of(again.read()) == {1: "a"} and again.numbers() == [1]
    assert again.vacuum() == 3 and rows_of(again.read()) == {1: "a"}


def test_writers_that_meet_both_count(spark, tmp_path, monkeypatch):
    store, other = (versions.KeyedStore(spark, f"{tmp_path}/s", "id") for _ in range(2))
    store.put(table(spark, [(1, "a")]))
    real, met = store.committed, []

    def late(version):
        if not met:  # another writer comes between
            met.append(other.put(table(spark, [(1, "other"), (2, "other")])).number)
        return real(version)

    monkeypatch.setattr(store, "committed", late)
    assert store.put(table(spark, [(1, "late")])).number == 3 and met == [2]
    assert rows_of(store.read()) == {1: "late", 2: "other"}
    met.clear()
    assert store.compact().segments[1:] == other.version(4).segments[-1:]
    assert rows_of(store.read()) == {1: "other", 2: "other"}


def test_edges(spark, tmp_path):
    store = versions.KeyedStore(spark, f"{tmp_path}/s", "id")
    with pytest.raises(versions.NothingStored):
        store.read()
    assert store.add(table(spark, [(1, "a"), (1, "b"), (None, "n")])).number == 1
    got = rows_of(store.read())
    assert got.keys() == {1, None} and got[1] in "ab"
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame([(1, 2)], "id long, other long"))
    store.delete(table(spark, [(99, None), (None, None)]))
    assert rows_of(store.read()).keys() == {1}
    store.put(table(spark, []))
    assert rows_of(store.read()).keys() == {1}
    assert store.vacuum(2) == 0 and len(store.history()) == 2
    with pytest.raises(versions.NothingStored):
        store.read(1)
    assert store.read().where(F.col("id") == 1).count() == 1
