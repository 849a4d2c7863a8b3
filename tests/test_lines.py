import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from querent.streaming import events, lines


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    lines.registered(spark)


def written(spark, source, folder, state):
    stream = spark.readStream.schema("key string, seq int, line string").option("maxFilesPerTrigger", 1).json(source)
    query = stream.writeStream.format(lines.FORMAT).option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def told(spark, folder, out):
    found = events.drained(spark.readStream.format(lines.FORMAT).option("path", folder).load(), "lines", folder=out)
    return sorted((r.key, r.seq, r.line) for r in found.collect())


def add(spark, source, rows):
    spark.createDataFrame(rows, "key string, seq int, line string").coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(source)


def test_streams_that_start_anew_lose_and_repeat_nothing(spark, tmp_path):
    source, folder, state, out = (f"{tmp_path}/{n}" for n in ("source", "folder", "state", "out"))
    want = []
    for k in range(4):
        rows = [(f"k{k}", n, None if n == 2 else json.dumps({"n": n, "text": "ä\n" * n})) for n in range(5)]
        want += rows
        add(spark, source, rows[:3])
        add(spark, source, rows[3:])
        written(spark, source, folder, state)
        assert told(spark, folder, out) == sorted(want, key=lambda r: r[:2])
    assert len(list(Path(folder, "batches").iterdir())) == 8


def test_a_batch_that_is_written_again_counts_once(spark, tmp_path):
    source, folder, state = (f"{tmp_path}/{n}" for n in ("source", "folder", "state"))
    add(spark, source, [("a", 0, "one")])
    written(spark, source, folder, state)
    (commit,) = [p for p in Path(state, "commits").iterdir() if p.name == "0"]
    commit.unlink()  # as if the query had stopped between its commit and Spark's note of it
    for crc in Path(state, "commits").glob(".*.crc"):
        crc.unlink()
    add(spark, source, [("b", 0, "two")])
    written(spark, source, folder, state)
    assert told(spark, folder, f"{tmp_path}/out") == [("a", 0, "one"), ("b", 0, "two")]
    assert len(list(Path(folder, "parts").iterdir())) == 2
    shutil.copy(next(Path(folder, "parts").iterdir()), Path(folder, "parts", "left-behind.json"))
    assert told(spark, folder, f"{tmp_path}/again") == [("a", 0, "one"), ("b", 0, "two")]


def test_an_empty_folder_is_an_empty_stream(spark, tmp_path):
    assert told(spark, f"{tmp_path}/none", f"{tmp_path}/out") == []
    assert spark.readStream.format(lines.FORMAT).option("path", f"{tmp_path}/none").load().select(F.col("line")).isStreaming
