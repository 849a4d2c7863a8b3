"""Queries that run as streams, and windows over events, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.vectors import embedded
from querent.operators.chunking import naive_chunks
from querent.plans.answering import answered, answered_through_cache, build_index
from querent.plans.config import Config
from querent.plans.search_queries import WORDS, chunks, embedded_sql, text_queries
from querent.operators import evaluation
from querent.operators.asof import asof_join
from querent.session import stored, stored_dir
from querent.streaming import answers, events, lines
from querent.tables import table


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of documents cut into chunks gives the rows of the batch query."""
    found = events.ingested(events.table_stream(spark, sf, "documents").select("doc_id", "text"), naive_chunks)
    return found.select("doc_id", F.col("pos").cast("int").alias("pos"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return events.tumbling(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def events_session(spark: SparkSession, sf: str) -> DataFrame:
    return events.sessions(table(spark, sf, "events")).select("user_id", F.col("session").cast("long").alias("session"), "start", "n")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the stream of events that the watermark has closed."""
    found = events.drained(events.session_windows(events.table_stream(spark, sf, "events", 100_000)), "sessions")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("until"), "n")


def stream_followed(spark: SparkSession, sf: str) -> DataFrame:
    """Views and the user's purchases within the hour after them, as a join of two streams."""
    kind = lambda name: events.table_stream(spark, sf, "events", 100_000).where(F.col("event_type") == name)
    return events.drained(events.followed(kind("view"), kind("purchase")), "followed").select("user_id", "first_id", "then_id")


def asof_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with its user's last view at or before it."""
    own = table(spark, sf, "events")
    views = own.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = own.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(buys, views, ["user_id"], "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


def latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of merged daily sketches: whether their ranks are within a hundredth of those asked for."""
    own = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = stored(evaluation.sketched(own, ["event_type", "day"], "value"), "sketches")
    found = evaluation.sketch_percentiles(evaluation.sketches_merged(daily, ["event_type"]), (0.5, 0.95))
    ranks = own.join(F.broadcast(found), "event_type").groupBy("event_type", "n")  # one row a type
    share = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    return ranks.agg((F.abs(share("p50") - 0.5) <= 0.01).alias("p50_near"), (F.abs(share("p95") - 0.95) <= 0.01).alias("p95_near"))


def stream_chat_state(spark: SparkSession, sf: str) -> DataFrame:
    return events.latest_histories(events.drained(events.chat_histories(events.table_stream(spark, sf, "conversations")), "chats"))


def stream_chat_window(spark: SparkSession, sf: str) -> DataFrame:
    """The histories of ``stream_chat_state`` from state that holds no more than the window and what waits; turns are dealt over ten files in mixed order."""
    folder = f"{stored_dir(spark)}/turns-{uuid.uuid4().hex}"
    table(spark, sf, "conversations").repartition(10, F.xxhash64("conv_id", "turn")).write.parquet(f"{folder}/conversations.parquet")
    return events.latest_histories(events.drained(events.chat_states(events.table_stream(spark, folder, "conversations", 2)), "chats"))


def answer_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item answered by hybrid retrieval with re-ranking over the documents."""
    config = Config(retriever="hybrid", rerank=True, top_k=5)
    rows = answered(build_index(chunks(spark, sf), config), text_queries(spark, sf), config)
    return rows.select("qid", "answer", F.size("chunks").alias("n_chunks"), F.col("chunks")[0]["source"].alias("first_source"))


def embed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of the benchmark items, their places that aren't zero."""
    rows = embedded(text_queries(spark, sf), "qtext", "qvec").select("qid", F.posexplode("qvec").alias("pos", "x"))
    return rows.where("x != 0").select("qid", "pos", F.round("x", 6).alias("x"))


def told_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The assistant's turns as a stream of answers; every seventh conversation fails after its words."""
    turns = events.table_stream(spark, sf, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("conv_id") % 7 == 0, F.lit("model gone")).alias("error"), F.create_map(F.lit("role"), F.col("role")).alias("config"))


def answers_read(found: DataFrame) -> DataFrame:
    rows = answers.read_lines(found, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.md5(F.col("answer").cast("binary")).alias("text_md5"), "error", F.col("config")["role"].alias("role"))


def stream_answer_events(spark: SparkSession, sf: str) -> DataFrame:
    """The assistant's turns as a stream of JSON events, written and read again."""
    return answers_read(events.drained(answers.answer_lines(told_turns(spark, sf), ["conv_id", "turn"]), "answers"))


def stream_event_source(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the data source of event lines: one stream writes to it, another reads from it."""
    lines.registered(spark)
    folder = events.new_folder(spark, "event-lines")
    told = answers.answer_lines(told_turns(spark, sf), ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("seq").cast("int").alias("seq"), "line")
    told.writeStream.format(lines.FORMAT).option("path", folder).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    found = events.drained(spark.readStream.format(lines.FORMAT).option("path", folder).load(), "lines")
    key = F.split("key", ":")
    return answers_read(found.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "seq", "line"))


def cache_events(spark: SparkSession, sf: str) -> DataFrame:
    """Items answered without retrieval when those of even ids are stored already."""
    asked, config = text_queries(spark, sf), Config(no_rag=True)
    path = f"{stored_dir(spark)}/answers-{uuid.uuid4().hex}"
    answered_through_cache(lambda: None, asked.where("qid % 2 = 0"), config, path)
    return answers.cache_events(answered_through_cache(lambda: None, asked, config, path), config.no_rag)


QUERIES = {f.__name__: f for f in (stream_ingest, events_tumbling, events_session, stream_sessions, stream_followed, asof_events, latency_sketches, stream_chat_state, stream_chat_window, answer_pipeline, embed_queries, stream_answer_events, stream_event_source, cache_events)}
ORACLES = {
    "stream_answer_events": "SELECT conv_id, turn, md5(text) AS text_md5, CASE WHEN conv_id % 7 = 0 THEN 'model gone' END AS error, role FROM conversations WHERE role = 'assistant'",
    "cache_events": "WITH r AS (SELECT item_id AS qid, text IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) AS cached FROM benchmark) SELECT qid, 1::INTEGER AS step, CASE WHEN cached THEN 'cached' ELSE 'generate' END AS event FROM r",
    "stream_ingest": "SELECT doc_id, pos::INTEGER AS pos, md5(substr(text, pos * 480 + 1, 500)) AS text_md5 FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 0 THEN (length(text) - 1) // 480 + 1 ELSE 0 END)) AS pos FROM documents)",
    "events_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY ALL",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g), r AS (SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS until, count(*) AS n FROM s GROUP BY user_id, session) SELECT * FROM r WHERE date_trunc('milliseconds', until) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)",
    "stream_followed": "SELECT v.user_id, v.event_id AS first_id, p.event_id AS then_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'",
    "asof_events": "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, v.view_id, v.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "latency_sketches": "SELECT event_type, count(value) AS n, true AS p50_near, true AS p95_near FROM events GROUP BY event_type",
    "stream_chat_state": "SELECT conv_id, turn, coalesce(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations",
    "embed_queries": f"WITH q AS (SELECT item_id AS qid, {WORDS.format(t='text')} AS w FROM benchmark), {embedded_sql('qe', 'qid', 'q', 'w')} SELECT qid, b::INTEGER AS pos, round(x, 6) AS x FROM qe WHERE x <> 0",
}
ORACLES["stream_chat_window"] = ORACLES["stream_chat_state"]
ORACLES["stream_event_source"] = ORACLES["stream_answer_events"]
