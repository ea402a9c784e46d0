"""Keyed state over event streams. Each function takes a stream or a table, unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_spend(events: DataFrame, key: str, ts: str, cents: Column, length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """key, window_start, n, cents of sliding windows; events later than `late` are left out of a stream."""
    grouped = events.withWatermark(ts, late).groupBy(F.col(key), F.window(ts, length, slide))
    return grouped.agg(F.count("*").alias("n"), F.sum(cents).alias("cents")).select(key, F.col("window.start").alias("window_start"), "n", "cents")


def sessions(events: DataFrame, key: str, ts: str, idle: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """key, started, evicted (when `idle` has passed), n: a room is kept while events come within `idle`."""
    grouped = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, idle))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("evicted"), "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str, within: str = "1 hour") -> DataFrame:
    """Of a stream: events without those that repeat the keys within a time."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def latest_snapshots(events: DataFrame, key: str, ts: str, value: str, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """key, saved_at, value: the last value of each key in each stretch of time, one save instead of one a change."""
    grouped = events.withWatermark(ts, late).groupBy(F.col(key), F.window(ts, every))
    return grouped.agg(F.max_by(value, ts).alias("value")).select(key, F.col("window.end").alias("saved_at"), "value")


def _take(tokens: float, last: float | None, at: float, capacity: float, rate: float) -> tuple[float, float, bool]:
    """A bucket's tokens and time after a request, and whether it was accepted."""
    if last is not None:
        tokens = min(capacity, tokens + max(0.0, at - last) * rate)
    accepted = tokens >= 1
    return tokens - accepted, at if last is None else max(at, last), accepted


def _bucket(capacity: float, rate: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        accepted = []
        for at in rows["at"]:
            tokens, last, ok = _take(tokens, last, at, capacity, rate)
            accepted.append(ok)
        state.update((tokens, last))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "accepted": accepted})

    return step


def token_bucket(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """Of a stream requests(key, event_id, at in seconds): which are accepted. A micro-batch holds a bounded part of a key.

    A bucket starts full, gains `rate` tokens a second up to its capacity, and an accepted request takes one.
    """
    return requests.groupBy("key").applyInPandasWithState(_bucket(capacity, rate), "key long, event_id long, accepted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def token_bucket_table(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """The same of a table: keys are dealt and sorted by Spark, and a task reads its rows in order, holding one bucket at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, capacity, None
        for rows in batches:
            accepted = []
            for k, at in zip(rows["key"], rows["at"], strict=True):
                if k != key:
                    key, tokens, last = k, capacity, None
                tokens, last, ok = _take(tokens, last, at, capacity, rate)
                accepted.append(ok)
            yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "accepted": accepted})

    ordered = requests.filter("key is not null").select("key", "event_id", "at").repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(run, "key long, event_id long, accepted boolean")
