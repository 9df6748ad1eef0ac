"""Streaming forms of the serving state: session history, running statistics, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def model_totals(responses: DataFrame) -> DataFrame:
    """Answers and mean response time per model, for update or complete mode."""
    return responses.groupBy("model_used").agg(F.count("*").alias("answers"), F.round(F.avg("response_time"), 6).alias("mean_time"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means per event type and window; events later than the watermark are dropped."""
    per = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return per.agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean_value")).select(F.col("w.start").alias("hour"), "event_type", "events", "mean_value")


def session_totals(queries: DataFrame, idle: str = "2 hours") -> DataFrame:
    """Running number of distinct queries and last time of every session, with the ids seen so far as state.

    A session's state holds its distinct ids only, and goes when the watermark has passed its last query by ``idle``: a
    query that is that late is dropped, and one that comes in time after such a pause begins the session's count anew.
    """
    seconds = int(pd.Timedelta(idle).total_seconds())

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        for batch in batches:
            seen |= set(batch["query_id"].dropna())
            last = max(last, *(int(t.value // 1000) for t in batch["asked_at"].dropna()), 0)
        state.update((sorted(seen), last))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "queries": [len(seen)], "last_us": [last]})

    timed = queries.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", idle)
    return timed.groupBy("session_id").applyInPandasWithState(update, "session_id string, queries long, last_us long", "seen array<string>, last long", "update", GroupStateTimeout.EventTimeTimeout)
