"""State with timers over event streams (transformWithState), each with a twin that gives the same over a table.

A stream needs spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB provider and a watermark on its time column. Rows later than the watermark
are left out by Spark. Timers run in event time: they fire once the watermark has passed them, so that a replay gives the same.
"""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.geometry import snapped

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limit:
    """A token bucket and the times at which it overflowed: what one connection's requests meet.

    The bucket starts full and gains `rate` tokens a second up to its capacity; a request takes one or overflows. Overflows older than
    `window` seconds before the latest one no longer count, and `most` that count end the connection.
    """

    def __init__(self, capacity: float, rate: float, window: float = 30.0, most: int = 5):
        self.capacity, self.rate, self.window, self.most = capacity, rate, window, most
        self.tokens, self.last, self.overflows = capacity, None, deque()

    def request(self, at: float) -> tuple[bool, int, bool]:
        """accepted, how many overflows count, whether the connection is to end."""
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + max(0.0, at - self.last) * self.rate)
        self.last = at if self.last is None else max(at, self.last)
        accepted = self.tokens >= 1
        if accepted:
            self.tokens -= 1
        else:
            self.overflows.append(at)
            while self.overflows[0] < at - self.window:
                self.overflows.popleft()
        return accepted, len(self.overflows), len(self.overflows) >= self.most

    def idle_at(self) -> float:
        """From when on this state equals a new one: the bucket is full again and no overflow counts."""
        return self.last + max((self.capacity - self.tokens) / self.rate if self.rate else float("inf"), self.window if self.overflows else 0.0)


LIMITED = "key long, event_id long, accepted boolean, overflows int, ends boolean"


class _Limited(StatefulProcessor):
    """One key's limit as state: a value for the bucket, a list for the overflows, a timer that lets both go when they equal new ones."""

    def __init__(self, settings: tuple):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")
        self.overflows = handle.getListState("overflows", "at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        limit = Limit(*self.settings)
        if self.bucket.exists():
            limit.tokens, limit.last = self.bucket.get()
            limit.overflows = deque(x[0] for x in self.overflows.get())
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):  # a key's part of one micro-batch
            accepted, overflows, ends = limit.request(r.at)
            yield Row(key=key[0], event_id=r.event_id, accepted=accepted, overflows=overflows, ends=ends)
        self.bucket.update((limit.tokens, limit.last))
        self.overflows.put([(at,) for at in limit.overflows]) if limit.overflows else self.overflows.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if limit.idle_at() < float("inf"):
            self.handle.registerTimer(int(limit.idle_at() * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.bucket.clear()
        self.overflows.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(requests: DataFrame, capacity: float, rate: float, window: float = 30.0, most: int = 5, late: str = "1 minute") -> DataFrame:
    """Of a stream requests(key long, event_id long, ts timestamp): key, event_id, accepted, overflows (that count after it), ends.

    Requests of one key are taken in order of time within a micro-batch; one earlier than those of a micro-batch before finds the bucket as they left
    it. State of a key that is idle for long goes by a timer, which changes no result.
    """
    timed = requests.withWatermark("ts", late).select("key", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("key").transformWithState(_Limited((capacity, rate, window, most)), LIMITED, "append", "EventTime")


def limited_table(requests: DataFrame, capacity: float, rate: float, window: float = 30.0, most: int = 5) -> DataFrame:
    """The same of a table: keys are dealt and sorted by Spark, and a task reads its rows in order, holding one key's state at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limit = None, None
        for rows in batches:
            out = []
            for k, at in zip(rows["key"], rows["at"], strict=True):
                if k != key:
                    key, limit = k, Limit(capacity, rate, window, most)
                out.append(limit.request(at))
            accepted, overflows, ends = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "accepted": accepted, "overflows": pd.Series(overflows, dtype="int32"), "ends": ends})

    timed = requests.filter("key is not null").select("key", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, LIMITED)


SAVED = "key long, saved_at timestamp, value string"


def saves_of(changes: Iterable[tuple[float, str]], every: float, last: str | None, until: float) -> tuple[list[tuple[float, str, bool]], list[tuple[float, str]]]:
    """Changes(at, value) in order to the saves due by `until` as (at, value, whether it differs from the one before), and the changes that wait."""
    saves, waiting = [], list(changes)
    while waiting and waiting[0][0] + every <= until:
        due = waiting[0][0] + every
        n = sum(at <= due for at, _ in waiting)
        saves.append((due, waiting[n - 1][1], waiting[n - 1][1] != last))
        last, waiting = waiting[n - 1][1], waiting[n:]
    return saves, waiting


class _Saved(StatefulProcessor):
    """A key's changes since its last save, and that save's value; a timer, set by the first of those changes, makes the next save."""

    def __init__(self, every: float):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, event_id long, value string")
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = sorted([*(tuple(x) for x in self.waiting.get()), *((r.at, r.event_id, r.value) for r in rows)])
        self.waiting.put(waiting)
        self._arm(waiting)
        return iter(())

    def _arm(self, waiting: list) -> None:
        """One timer, for the first change that waits."""
        due = {int((waiting[0][0] + self.every) * 1000)} if waiting else set()
        armed = set(self.handle.listTimers())
        for timer in armed - due:
            self.handle.deleteTimer(timer)
        for timer in due - armed:
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = sorted(tuple(x) for x in self.waiting.get())
        last = self.last.get()[0] if self.last.exists() else None
        saves, rest = saves_of([(at, value) for at, _, value in waiting], self.every, last, timerValues.getCurrentWatermarkInMs() / 1000)
        rest = waiting[len(waiting) - len(rest) :]
        if saves:
            self.last.update((saves[-1][1],))
        self.waiting.put(rest) if rest else self.waiting.clear()
        self._arm(rest)
        for at, value, differs in saves:
            if differs:
                yield Row(key=key[0], saved_at=datetime.datetime.fromtimestamp(at, datetime.UTC), value=value)

    def close(self) -> None:
        pass


def saved(changes: DataFrame, every: float = 5.0, late: str = "1 minute") -> DataFrame:
    """Of a stream changes(key long, event_id long, ts timestamp, value string): key, saved_at, value of each save.

    The first change since the last save sets a timer, once; `every` seconds later the last value up to then is saved, unless it equals the
    one saved before. The value kept for that comparison should be a digest if values are long. Of changes at one time the last id holds.
    """
    timed = changes.withWatermark("ts", late).select("key", "event_id", "ts", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("key").transformWithState(_Saved(every), SAVED, "append", "EventTime")


def saved_table(changes: DataFrame, every: float = 5.0) -> DataFrame:
    """The same of a table: a change over `every` seconds after the one that set a timer sets the next, which is how positions snap. Runs jobs when it is called."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    timed = changes.filter("key is not null").select("key", "event_id", "value", at)
    opened = snapped(timed, ["key"], "at", every)
    last = timed.join(opened, ["key", "at"]).groupBy("key", "snapped").agg(F.max_by("value", F.struct("at", "event_id")).alias("value"))
    order = Window.partitionBy("key").orderBy("snapped")
    before = F.lag("value").over(order)
    kept = last.withColumns({"_before": before, "_first": F.row_number().over(order) == 1}).filter(F.col("_first") | ~F.col("value").eqNullSafe(F.col("_before")))
    return kept.select("key", F.timestamp_micros(F.round((F.col("snapped") + every) * 1e6).cast("long")).alias("saved_at"), "value")

