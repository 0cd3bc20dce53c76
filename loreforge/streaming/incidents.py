"""The same incidents over unbounded streams: keyed state per session, expired after a week."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loreforge.operators.events import LEAST_FAILURES

WEEK_MS = 7 * 24 * 3600 * 1000


def repeated_failures(events: DataFrame, week_ms: int = WEEK_MS) -> DataFrame:
    """``(session_id, key, at, count)`` of a stream ``events(session_id string, key string, at timestamp, seq long)`` of failures.

    State is one counter per session and command, dropped a week (of the watermark) after its
    last failure. Within a micro-batch failures are counted in order of time.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        counts = n + 1 + pd.Series(range(len(rows)), index=rows.index)
        state.update((n + len(rows),))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + week_ms)
        out = pd.DataFrame({"session_id": key[0], "key": key[1], "at": rows["at"], "count": counts})
        yield out[out["count"] >= LEAST_FAILURES]

    keyed = events.withWatermark("at", "1 hour").groupBy("session_id", "key")
    schema = "session_id string, key string, at timestamp, count long"
    return keyed.applyInPandasWithState(count, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def never_repeat(offers: DataFrame, week_ms: int = WEEK_MS) -> DataFrame:
    """``(session_id, id, at)``: the offers of a stream ``(session_id string, id long, at timestamp)`` that a session has not had before.

    State is one flag per session and id, however many a session is offered, dropped a week (of
    the watermark) after its last offer.
    """

    def fresh(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([f["at"] for f in frames])
        known = state.exists
        state.update((True,))
        state.setTimeoutTimestamp(max(int(times.max().timestamp() * 1000), state.getCurrentWatermarkMs()) + week_ms)
        if not known:
            yield pd.DataFrame({"session_id": [key[0]], "id": [key[1]], "at": [times.min()]})

    keyed = offers.withWatermark("at", "1 hour").groupBy("session_id", "id")
    return keyed.applyInPandasWithState(fresh, "session_id string, id long, at timestamp", "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream ``(user_id, ts, event_type, value)`` by inactivity gaps, with counts; works on batches too."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per type in tumbling or sliding windows; late rows beyond the watermark are dropped from streams."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def journal(incidents: DataFrame, path: str, checkpoint: str):
    """Appends a stream of incidents to JSON lines under ``path``; exactly once per ``checkpoint``."""
    return incidents.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
