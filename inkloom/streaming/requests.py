"""Structured Streaming forms of the request-log operators.

Inputs are streaming DataFrames of (key, event_id, ts, …). State is kept per key in the state store and
bounded by event time: windows close behind the watermark and idle keys expire.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (DEBOUNCE_SECONDS, RATE_MAX_REQUESTS, RATE_WINDOW_SECONDS, STALE_KEY_SECONDS)
from ..operators.events import micros


def windowed_counts(stream: DataFrame, window: int = RATE_WINDOW_SECONDS, limit: int = RATE_MAX_REQUESTS,
                    lateness: str = "1 minute") -> DataFrame:
    """Requests, admitted and denied per key and window; late rows behind the watermark are dropped."""
    counted = stream.withWatermark("ts", lateness).groupBy(
        "key", F.window("ts", f"{window} seconds").alias("slot")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("key", F.col("slot.start").alias("window_start"), "requests",
                          F.least(F.col("requests"), F.lit(limit)).alias("admitted"),
                          F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"))


def _trigger(batches: Iterator):
    """All rows that a key has in this trigger by time: Arrow delivers them in chunks of any size."""
    import pandas as pd

    return pd.concat(list(batches), ignore_index=True).sort_values(["t", "event_id"], ignore_index=True)


def admit(stream: DataFrame, window: int = RATE_WINDOW_SECONDS, limit: int = RATE_MAX_REQUESTS,
          lateness: str = "1 minute") -> DataFrame:
    """Admit or deny every request in arrival order, by time within a trigger: exact per key and window. State is the count
    of every window that the watermark has not passed, so a late request is judged by its own window."""
    size = window * 1_000_000

    def step(key, batches: Iterator, state) -> Iterator:
        import numpy as np

        counts = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        if not state.hasTimedOut:
            pdf = _trigger(batches)
            slot = pdf["t"].to_numpy() // size * size
            before = np.array([counts.get(int(s), 0) for s in slot])
            place = pdf.groupby(slot).cumcount().to_numpy() + before
            for s, n in zip(*np.unique(slot, return_counts=True), strict=True):
                counts[int(s)] = counts.get(int(s), 0) + int(n)
            yield pdf[["event_id"]].assign(key=key[0], admitted=place < limit)[["key", "event_id", "admitted"]]
        mark = state.getCurrentWatermarkMs()
        counts = {s: n for s, n in counts.items() if s // 1000 + window * 1000 > mark}
        if not counts:
            state.remove()
            return
        state.update((json.dumps(counts),))
        state.setTimeoutTimestamp(max(min(counts) // 1000 + window * 1000, mark + 1))

    ready = stream.withWatermark("ts", lateness).select("key", "event_id", "ts", micros("ts").alias("t"))
    return ready.groupBy("key").applyInPandasWithState(
        step, "key string, event_id long, admitted boolean", "counts string", "append", "EventTimeTimeout")


def debounce(stream: DataFrame, seconds: float = DEBOUNCE_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Drop events that follow the last kept event of their key too closely; state is that one time. Within a trigger
    events are taken by time; an event older than one kept by an earlier trigger is dropped, as the output is append-only."""
    gap = int(seconds * 1_000_000)

    def step(key, batches: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        pdf = _trigger(batches)
        t, kept, held = pdf["t"].to_numpy(), [], state.get[0] if state.exists else None
        at = 0 if held is None else int(np.searchsorted(t, held + gap))
        while at < len(t):  # jump from kept event to kept event
            kept.append(at)
            held = int(t[at])
            at = int(np.searchsorted(t, held + gap))
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"].to_numpy()[kept]})
        state.update((int(held),))
        state.setTimeoutTimestamp(max(held // 1000 + int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    ready = stream.withWatermark("ts", lateness).select("key", "event_id", "ts", micros("ts").alias("t"))
    return ready.groupBy("key").applyInPandasWithState(
        step, "key string, event_id long", "held long", "append", "EventTimeTimeout")


def expired_keys(stream: DataFrame, idle: int = STALE_KEY_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Keys whose last request is older than ``idle`` seconds behind the watermark, with their counts."""
    def step(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            count, last = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "count": [count], "last_us": [last]})
            return
        count, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            count, last = count + len(pdf), max(last, int(pdf["t"].max()))
        state.update((count, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle * 1000, state.getCurrentWatermarkMs() + 1))

    ready = stream.withWatermark("ts", lateness).select("key", "ts", micros("ts").alias("t"))
    return ready.groupBy("key").applyInPandasWithState(
        step, "key string, count long, last_us long", "count long, last long", "append", "EventTimeTimeout")


def latest_wins(stream: DataFrame) -> DataFrame:
    """Newest event per key; run in update mode."""
    return stream.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def active_sessions(events: DataFrame, sessions: DataFrame, validity: str = "7 days", lateness: str = "1 hour") -> DataFrame:
    """Events with the sessions of their user valid at that time: an interval join bounded by watermarks.

    ``validity`` bounds how long a session can live, so both sides of the join state can be dropped.
    """
    e = events.withWatermark("ts", lateness).alias("e")
    s = sessions.withWatermark("created", lateness).alias("s")
    valid = F.expr(f"e.user_id = s.user_id AND e.ts >= s.created AND e.ts < s.expires "
                   f"AND e.ts <= s.created + INTERVAL {validity}")
    return e.join(s, valid).select("e.event_id", "e.user_id", "e.ts", "s.session_id")
