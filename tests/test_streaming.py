import datetime as dt

import json

import pytest
from pyspark.sql import functions as F

from querent.operators.chunking import naive_chunks
from querent.streaming import answers, events

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_stream_of_files_is_ingested_once(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame([(k, "x" * 900) for k in range(20)], "doc_id long, text string")
    docs.repartition(5).write.parquet(path)
    stream = events.table_stream(spark, str(tmp_path), "documents", files_per_trigger=2)
    got = events.ingested(stream, lambda d: naive_chunks(d, 500, 20))
    assert got.count() == naive_chunks(docs, 500, 20).count() == 40


def test_a_stream_with_a_folder_takes_up_where_it_stopped(spark, tmp_path):
    path, cuts = f"{tmp_path}/documents.parquet", lambda d: naive_chunks(d, 500, 20)
    for k in range(3):
        spark.createDataFrame([(k, "x" * 900)], "doc_id long, text string").write.mode("append").parquet(path)
        got = events.ingested(events.table_stream(spark, str(tmp_path), "documents"), cuts, folder=f"{tmp_path}/chunks")
        assert sorted((r.doc_id, r.pos) for r in got.collect()) == [(d, p) for d in range(k + 1) for p in range(2)]


def test_windows_in_batch_and_stream(spark, tmp_path):
    rows = [(k, at(k * 7), k % 3, "ab"[k % 2], float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    batch = {tuple(r) for r in events.tumbling(df).collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = events.tumbling(events.table_stream(spark, str(tmp_path), "events"))
    closed = {tuple(r) for r in events.drained(stream, "windows").collect()}
    assert closed and closed <= batch  # the last windows stay open


def test_sessions_part_at_the_gap(spark):
    rows = [(1, at(0), 1), (2, at(30), 1), (3, at(61), 1), (4, at(0), 2)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    got = {(r.user_id, r.session, r.n) for r in events.sessions(df).collect()}
    assert got == {(1, 1, 2), (1, 2, 1), (2, 1, 1)}


def test_chat_state_over_several_batches(spark, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    for k in range(3):
        spark.createDataFrame([(1, 4 * k + j, "user", f"m{4 * k + j}") for j in range(4)], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(path)
    got = events.drained(events.chat_histories(events.table_stream(spark, str(tmp_path), "conversations", 1)), "chat")
    rows = {r.turn: r.history for r in got.collect()}
    assert len(rows) == 12 and all(h.count("User: ") <= 6 for h in rows.values())
    assert got.agg(F.max(F.length("history"))).first()[0] > 0


def test_turns_dealt_over_ten_files_equal_the_sql(spark, tmp_path):
    import random

    import duckdb

    from querent.plans import stream_queries

    rows = [(c, t, "user" if t % 2 else "assistant", f"m{c} {t}") for c in range(4) for t in range(25)]
    random.Random(3).shuffle(rows)
    for k in range(10):
        spark.createDataFrame(rows[k::10], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(stream_queries.ORACLES["stream_chat_state"]).fetchall()
    assert sorted(map(tuple, stream_queries.stream_chat_state(spark, str(tmp_path)).collect())) == sorted(want)


def test_answers_as_lines_and_back(spark):
    chunk = "array<struct<rank:int,text:string,source:string,score:double>>"
    rows = [(1, "two  words\nhere ", None, [(1, "t", "s", 0.5)], {"top_k": "3"}), (2, None, "ValueError: gone", None, None), (3, "", None, None, None)]
    told = spark.createDataFrame(rows, f"qid long, answer string, error string, chunks {chunk}, config map<string,string>")
    lines = answers.answer_lines(told, ["qid"])
    first = [json.loads(r.line) for r in lines.where("qid = 1").orderBy("seq").collect()]
    assert [e["type"] for e in first] == ["meta", "token", "token", "token"] and first[0]["config"] == {"top_k": "3"} and first[0]["hyde_doc"] is None
    assert "".join(e["text"] for e in first[1:]) == "two  words\nhere "
    got = {r.qid: r for r in answers.read_lines(lines, ["qid"]).collect()}
    assert (got[1].answer, got[1].error, got[1].chunks[0].source, got[1].config) == ("two  words\nhere ", None, "s", {"top_k": "3"})
    assert (got[2].answer, got[2].error) == ("", "ValueError: gone") and (got[3].answer, got[3].error) == ("", None)


def test_reader_skips_blank_lines_and_tells_what_is_wrong(spark):
    token = '{"type": "token", "text": "a"}'
    rows = [(1, 0, " \t"), (1, 1, '{"type": "meta", "chunks": []}'), (1, 2, ""), (1, 3, token), (2, 0, token), (3, 0, '{"type": "meta"}'), (3, 1, token), (3, 2, "cut off {")]
    lines = spark.createDataFrame(rows, "qid long, seq int, line string")
    got = {r.qid: (r.answer, r.error) for r in answers.read_lines(lines, ["qid"]).collect()}
    assert got == {1: ("a", None), 2: ("a", "no meta line"), 3: ("a", "a line is no event")}
    assert answers.read_lines(lines.where("qid = 1"), ["qid"], strict=True).first().answer == "a"
    with pytest.raises(Exception, match="no meta line"):
        answers.read_lines(lines.where("qid = 2"), ["qid"], strict=True).collect()
    assert answers.read_lines(lines.limit(0), ["qid"]).collect() == []


def test_events_of_the_cache(spark):
    found = spark.createDataFrame([(1, True), (2, False), (3, False)], "qid long, cached boolean")
    told = lambda **k: [(r.qid, r.event) for r in answers.cache_events(found, **k).orderBy("qid", "step").collect()]
    assert told() == [(1, "cached"), (2, "build"), (2, "generate"), (3, "generate")]
    assert told(no_rag=True) == [(1, "cached"), (2, "generate"), (3, "generate")]
    assert answers.cache_events(found.where("cached")).count() == 1


def plain_histories(turns, keep=6):
    out = {}
    for conv in {c for c, *_ in turns}:
        own = sorted(t for t in turns if t[0] == conv)
        for k, (_, turn, *_) in enumerate(own):
            out[conv, turn] = "\n".join(f"{role.title()}: {text}" for _, _, role, text in own[max(0, k - keep) : k])
    return out


def test_chat_window_over_ten_files_in_mixed_order(spark, tmp_path):
    import random

    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}-{t}") for c in range(7) for t in range(c * 4 + 1) if (c, t) != (3, 5)]
    random.Random(1).shuffle(turns)
    for k in range(10):
        spark.createDataFrame(turns[k::10], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    found = events.drained(events.chat_states(events.table_stream(spark, str(tmp_path), "conversations", 3)), "chat")
    assert {(r.conv_id, r.turn): r.history for r in events.latest_histories(found).collect()} == plain_histories(turns)
    whole = found.groupBy("conv_id", "turn").count()
    assert whole.count() == len(turns) and whole.agg(F.max("count")).first()[0] <= 4  # no more often than there are triggers


class Cell:
    def __init__(self, held=None):
        self.held = held

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held if isinstance(self.held, tuple) else iter(self.held or [])

    def update(self, value):
        self.held = value

    put = update

    def clear(self):
        self.held = None


class Timers(list):
    def getCurrentWatermarkInMs(self):
        return 1000

    def listTimers(self):
        return iter(self)

    deleteTimer = list.remove
    registerTimer = list.append


def test_chat_state_is_bounded_by_the_window_and_what_waits():
    import pandas as pd

    timers = Timers()
    work = events.Histories(3, 500)
    work.handle, work.next, work.window, work.waiting = timers, Cell(), Cell(), Cell()
    frame = lambda *turns: [pd.DataFrame([(1, t, "user", f"m{t}") for t in turns], columns=["conv_id", "turn", "role", "text"])]
    for t in range(200):
        (out,) = work.handleInputRows((1,), frame(t), timers)
        assert out.turn.tolist() == [t] and len(work.window.held) <= 3 and not work.waiting.held and not timers
    out = list(work.handleInputRows((1,), frame(203, 205), timers))[0]
    assert out.turn.tolist() == [203, 205] and [t for t, _ in work.waiting.held] == [203, 205] and timers == [1500]
    assert list(work.handleInputRows((1,), frame(200), timers))[0].turn.tolist() == [200, 203, 205]
    list(work.handleExpiredTimer((1,), timers, None))
    assert not work.waiting.held and [t for t, _ in work.window.held] == [200, 203, 205] and work.next.held[0] == 206
    late = list(work.handleInputRows((1,), frame(201), timers))[0]
    assert (late.turn.tolist(), late.history.tolist()) == ([201], ["User: m200"])


def test_a_timer_settles_what_waits(spark, tmp_path):
    for k, (turn, minutes) in enumerate([(0, 0), (2, 1), (9, 600), (10, 1200)]):
        rows = [(1 if turn < 9 else 2, turn, "user", f"m{turn}", at(minutes))]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
        found = events.drained(events.chat_states(events.table_stream(spark, str(tmp_path), "conversations", 1), time="ts"), f"chat{k}", folder=f"{tmp_path}/out")
    assert {(r.conv_id, r.turn): r.history for r in events.latest_histories(found).collect()} == {(1, 0): "", (1, 2): "User: m0", (2, 9): "", (2, 10): "User: m9"}


EVENT = "event_id long, user_id long, event_type string, ts timestamp"


def dealt(spark, folder, rows, files):
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_session_windows_over_triggers_and_late_rows(spark, tmp_path):
    import random

    rnd = random.Random(2)
    rows = sorted(((k, k % 4, "view", at(rnd.randint(0, 3000))) for k in range(200)), key=lambda r: r[3])
    late = [(900 + k, 0, "view", at(-600 * (k + 1))) for k in range(3)]
    dealt(spark, tmp_path, [*rows, *late], 6)
    stream = events.session_windows(events.table_stream(spark, str(tmp_path), "events", 1))
    found, dropped = events.drained_counting(stream, "sessions")
    batch = {tuple(r) for r in events.session_windows(spark.createDataFrame(rows, EVENT)).collect()}
    closed = {tuple(r) for r in found.collect()}
    end = max(r[3] for r in rows) - dt.timedelta(minutes=10)
    assert dropped == 3 and closed == {r for r in batch if r[2] <= end} and 0 < len(closed) < len(batch)


def test_joined_streams_equal_the_batch(spark, tmp_path):
    import random

    rnd = random.Random(3)
    rows = sorted(((k, k % 3, rnd.choice(["view", "buy"]), at(rnd.randint(0, 2000))) for k in range(150)), key=lambda r: r[3])
    dealt(spark, tmp_path, rows, 5)
    kind = lambda df, name: df.where(F.col("event_type") == name)
    whole = spark.createDataFrame(rows, EVENT)
    for outer in (False, True):
        stream = lambda: events.table_stream(spark, str(tmp_path), "events", 1)
        found = {tuple(r) for r in events.drained(events.followed(kind(stream(), "view"), kind(stream(), "buy"), outer=outer), "followed").collect()}
        batch = {tuple(r) for r in events.followed(kind(whole, "view"), kind(whole, "buy"), outer=outer).collect()}
        open_after = max(r[3] for r in rows) - dt.timedelta(minutes=90)
        assert {r for r in found if r[2] <= open_after} == {r for r in batch if r[2] <= open_after} and found <= batch
        if not outer:
            assert found == batch


def test_streams_are_cleared_with_the_stored_tables(spark, tmp_path):
    from querent.session import stored_dir

    dealt(spark, tmp_path, [(1, 1, "view", at(0))], 1)
    found = events.drained(events.table_stream(spark, str(tmp_path), "events"), "plain")
    assert all(stored_dir(spark) in f for f in found.inputFiles())


def test_sketches_are_near_the_exact_percentiles(spark):
    from querent.operators import evaluation

    rows = spark.range(60_000).selectExpr("id % 3 AS g", "id % 17 AS part", "CAST(pow(rand(5), 3) * 1000 AS DOUBLE) AS v").unionByName(spark.createDataFrame([(0, 0, None)], "g long, part long, v double"))
    own = rows.cache()
    merged = evaluation.sketches_merged(evaluation.sketched(own, ["g", "part"], "v"), ["g"])
    for r in evaluation.sketch_percentiles(merged, (0.05, 0.5, 0.95)).collect():
        values = sorted(x.v for x in own.where(F.col("g") == r.g).collect() if x.v is not None)
        assert r.n == len(values)
        for share, got in ((0.05, r.p05), (0.5, r.p50), (0.95, r.p95)):
            assert abs(sum(v <= got for v in values) / len(values) - share) <= 0.01
    assert merged.agg(F.max(F.length("sketch"))).first()[0] < 20_000
