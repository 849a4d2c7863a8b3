"""Streams: documents into chunks, windows over events, and conversations by key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from querent.session import stored_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream; a table is a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}[.]parquet")  # a pattern may name a file


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream among the stored tables, which ``clear`` deletes with them."""
    return f"{stored_dir(spark)}/{name}-{uuid.uuid4().hex}"


def started(stream: DataFrame, mode: str, folder: str) -> StreamingQuery:
    """The query that writes what a stream has now."""
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}-state").format("parquet").option("path", folder).start()


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All that a stream has now, written to the shared folder by a query that ends, and read from there.

    With a ``folder`` of its own a stream takes up where its last run stopped, and reads only what is new.
    """
    folder = folder or new_folder(stream.sparkSession, name)
    started(stream, mode, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def ingested(stream: DataFrame, cut: Callable[[DataFrame], DataFrame], name: str = "chunks", folder: str | None = None) -> DataFrame:
    """The chunks of a stream of documents; with a ``folder`` those of earlier runs stay in it."""
    return drained(cut(stream), name, folder=folder)


def watched(events: DataFrame, late: str, at: str = "ts") -> DataFrame:
    """A stream with a watermark, which needs times with a zone."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of each window; a stream waits ``late`` for late events."""
    rows = watched(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session, start, n): a user's events that are no more than a gap apart."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(own)
    rows = events.withColumn("session", F.sum((F.coalesce(gap, F.lit(2**62)) > gap_minutes * 60_000_000).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("n"))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions as windows that end a ``gap`` after their last event; a stream says one once the watermark has passed its end."""
    rows = watched(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def followed(first: DataFrame, then: DataFrame, within: str = "1 hour", late: str = "10 minutes", outer: bool = False) -> DataFrame:
    """(user_id, first_id, first_ts, then_id, then_ts): events of a user and those of the other kind up to ``within`` later.

    Streams hold a row only until the watermark says that no partner can come; with ``outer`` a row without one is said then.
    """
    a = first.select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = then.select(F.col("user_id").alias("then_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    a, b = watched(a, late, "first_ts"), watched(b, late, "then_ts")
    near = (F.col("user_id") == F.col("then_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "leftOuter" if outer else "inner").select("user_id", "first_id", "first_ts", "then_id", "then_ts")


def drained_counting(stream: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, int]:
    """``drained``, and how many rows came too late for the state that they belong to."""
    folder = folder or new_folder(stream.sparkSession, name)
    query = started(stream, "append", folder)
    query.awaitTermination()
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in map(json.loads, (q.json for q in query.recentProgress)) for op in p.get("stateOperators", []))
    return stream.sparkSession.read.schema(stream.schema).parquet(folder), late


def chat_histories(turns: DataFrame, keep: int = 6) -> DataFrame:
    """(conv_id, turn, history) of a stream of turns, with the ``keep`` messages before each in order of turn.

    Turns come in any order over files, triggers and Arrow frames: those of a conversation are held as state by number.
    Only the end of what the stream has now tells that no earlier turn is to come, so each trigger says anew what it
    may change, under a rising ``version``; ``latest_histories`` keeps the last of each turn.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        version, numbers, messages = state.get if state.exists else (0, [], [])
        held = list(zip(numbers, messages, strict=True))
        first = None
        for frame in frames:
            for row in frame.itertuples():
                held.append((row.turn, f"{str(row.role).title()}: {row.text}"))
                first = row.turn if first is None else min(first, row.turn)
        held.sort(key=lambda x: x[0])
        at = next((k for k, x in enumerate(held) if first is not None and x[0] >= first), len(held))
        out = [(key[0], held[k][0], "\n".join(m for _, m in held[max(0, k - keep) : k]), version) for k in range(at, len(held))]
        state.update((version + 1, [x[0] for x in held], [x[1] for x in held]))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "version"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, history string, version long", "version long, numbers array<long>, messages array<string>", "append", GroupStateTimeout.NoTimeout)


def latest_histories(found: DataFrame) -> DataFrame:
    """(conv_id, turn, history): the rows of the last version of each turn."""
    last = Window.partitionBy("conv_id", "turn").orderBy(F.desc("version"))
    return found.withColumn("place", F.rank().over(last)).where("place = 1").select("conv_id", "turn", "history")


class Histories(StatefulProcessor):
    """Each turn's history from the ``keep`` messages before it; see ``chat_states``."""

    def __init__(self, keep: int, expiry_ms: int | None, first: int = 0):
        self.keep, self.expiry_ms, self.first = keep, expiry_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "turn long, version long")
        self.window = handle.getListState("window", "turn long, message string")
        self.waiting = handle.getListState("waiting", "turn long, message string")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(r.turn), f"{str(r.role).title()}: {r.text}") for frame in rows for r in frame.itertuples()]
        yield from self.told(key, new, None)
        if self.expiry_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.expiry_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The turns that are missing won't come: those that wait are settled as they are."""
        yield from self.told(key, [], self.settled_up_to())

    def settled_up_to(self) -> int | None:
        turns = [t for t, _ in self.waiting.get()]
        return max(turns) if turns else None

    def told(self, key, new, up_to):
        import pandas as pd

        upcoming, version = self.next.get() if self.next.exists() else (self.first, 0)
        window = [tuple(x) for x in self.window.get()] if self.window.exists() else []
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        known = sorted([(*x, False) for x in window + waiting] + [(*x, True) for x in new], key=lambda x: x[0])
        first = min((t for t, _ in new), default=None)
        out = [(key[0], t, "\n".join(m for _, m, _ in known[max(0, k - self.keep) : k]), version) for k, (t, _, fresh) in enumerate(known) if fresh or first is not None and t >= first and t >= upcoming]
        for t, _, _ in known:
            if t <= upcoming or up_to is not None and t <= up_to:
                upcoming = max(upcoming, t + 1)
        done = [(t, m) for t, m, _ in known if t < upcoming][-self.keep :] if self.keep else []
        left = [(t, m) for t, m, _ in known if t >= upcoming]
        self.next.update((upcoming, version + 1))
        for state, rows in ((self.window, done), (self.waiting, left)):
            state.put(rows) if rows else state.clear()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "version"])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chat_states(turns: DataFrame, keep: int = 6, time: str | None = None, late: str = "10 minutes", expiry_ms: int = 3_600_000) -> DataFrame:
    """(conv_id, turn, history, version) of a stream of turns numbered from 0, with the ``keep`` messages before each in order of turn.

    State holds the last ``keep`` messages of a conversation up to which no turn is missing, and the turns beyond a missing one. A turn
    whose predecessors are all there is said once; one that waits for some is said as things stand, and again under a higher
    ``version`` when they come (``latest_histories`` keeps the last). Where turns have a column of ``time``, a timer settles what waits once
    the watermark is ``expiry_ms`` beyond the last news, so the state of a conversation that is never completed shrinks to its window too.
    A turn that comes after that, or a second time, is said with what the window still has before it. Timers go by the time of
    events, as a query that ends with what there is would never end by that of the clock.
    """
    spark = turns.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # state of several variables needs it
    if time is not None:
        turns = turns.withWatermark(time, late)
    work = Histories(keep, expiry_ms if time is not None else None)
    return turns.groupBy("conv_id").transformWithStateInPandas(work, "conv_id long, turn long, history string, version long", "append", "none" if time is None else "eventTime")
