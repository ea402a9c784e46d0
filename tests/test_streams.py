"""Streaming functions on real streams: files that arrive one by one, late rows among them."""

import datetime

import pytest
from lathework.streaming import events
from pyspark.sql import functions as F

START = datetime.datetime(2024, 1, 1)
SCHEMA = "key long, event_id long, ts timestamp, cents long"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a function over a stream of batches of (key, event_id, seconds, cents), one file and one micro-batch each."""

    def run(batches, function, mode="append"):
        for n, batch in enumerate(batches):
            rows = spark.createDataFrame([(k, i, at(s), c) for k, i, s, c in batch], SCHEMA)
            rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        name = f"out_{abs(hash(str(tmp_path))) % 10**9}"
        query = function(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return [tuple(r) for r in spark.table(name).collect()]

    return run


HOUR = 3600
DAY = 24 * HOUR


def test_rolling_spend_leaves_late_events_out(streamed):
    batches = [[(1, 1, HOUR, 10), (2, 2, 2 * HOUR, 5)], [(1, 3, 3 * DAY, 7)], [(3, 8, 3 * DAY + 1, 2)], [(1, 4, HOUR, 1000)], [(1, 5, 20 * DAY, 1)], [(1, 6, 40 * DAY, 1)]]
    got = streamed(batches, lambda s: events.rolling_spend(s, "key", "ts", F.col("cents"), length="1 day", slide="1 day", late="1 day"))
    # Event 4 belongs to a window that was closed two days before. (A watermark holds from the batch after next.)
    assert sorted(got) == sorted([(1, START, 1, 10), (2, START, 1, 5), (1, at(3 * DAY), 1, 7), (3, at(3 * DAY), 1, 2), (1, at(20 * DAY), 1, 1)])


def test_sessions_end_when_idle(streamed, spark):
    batches = [[(1, 1, 0, 0), (1, 2, 200, 0)], [(1, 3, 450, 0), (2, 4, 460, 0)], [(1, 5, 1000, 0)], [(1, 6, DAY, 0)], [(1, 7, 2 * DAY, 0)]]
    function = lambda s: events.sessions(s, "key", "ts", idle="5 minutes", late="1 minute")
    got = streamed(batches, function)
    assert sorted(got) == sorted([(1, at(0), at(750), 3), (2, at(460), at(760), 1), (1, at(1000), at(1300), 1), (1, at(DAY), at(DAY + 300), 1)])
    table = spark.createDataFrame([(k, i, at(s), c) for b in batches[:-1] for k, i, s, c in b], SCHEMA)
    assert sorted(got) == sorted(map(tuple, function(table).collect()))


def test_repeats_within_a_time_go(streamed):
    batches = [[(1, 1, 0, 0), (1, 1, 5, 0)], [(1, 1, 60, 0), (1, 2, 61, 0)], [(2, 3, 3 * HOUR, 0)], [(2, 3, 3 * HOUR + 1, 0)], [(1, 9, 10, 0)]]
    got = streamed(batches, lambda s: events.without_repeats(s, ["key", "event_id"], "ts", within="1 hour").select("key", "event_id"))
    assert sorted(got) == [(1, 1), (1, 2), (2, 3)]  # the last event comes three hours late


def test_snapshots_keep_the_last_value(streamed):
    batches = [[(1, 1, 0, 10), (1, 2, 3, 11), (2, 3, 4, 20)], [(1, 4, 4, 12), (1, 5, 8, 13)], [(1, 6, DAY, 0)], [(1, 7, 2 * DAY, 0)]]
    got = streamed(batches, lambda s: events.latest_snapshots(s, "key", "ts", "cents"))
    assert sorted(got) == sorted([(1, at(5), 12), (2, at(5), 20), (1, at(10), 13), (1, at(DAY + 5), 0)])


def plain_bucket(rows, capacity, rate):
    buckets, out = {}, []
    for key, event, now in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        tokens, last = buckets.get(key, (capacity, now))
        tokens = min(capacity, tokens + (now - last) * rate)
        out.append((key, event, tokens >= 1))
        buckets[key] = (tokens - (tokens >= 1), now)
    return sorted(out)


def test_token_bucket(streamed, spark):
    import random

    rng = random.Random(2)
    times = sorted(rng.uniform(0, 40) for _ in range(120))
    rows = [(rng.randrange(3), i, round(t, 3)) for i, t in enumerate(times)]
    want = plain_bucket(rows, 3.0, 0.5)
    assert {w[2] for w in want} == {True, False}
    requests = lambda s: s.select("key", "event_id", ((F.unix_micros("ts") - int(START.replace(tzinfo=datetime.UTC).timestamp()) * 10**6) / 1e6).alias("at"))
    got = streamed([[(k, i, s, 0) for k, i, s in rows[a : a + 30]] for a in range(0, 120, 30)], lambda s: events.token_bucket(requests(s), 3.0, 0.5))
    assert sorted(got) == want
    table = spark.createDataFrame([*rows, (None, 999, 1.0)], "key long, event_id long, at double")
    assert sorted(map(tuple, events.token_bucket_table(table, 3.0, 0.5).collect())) == want
    case = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 0, 0, 1, 1))], "key long, event_id long, at double")
    assert [r.accepted for r in events.token_bucket_table(case, 2.0, 1.0).orderBy("event_id").collect()] == [True, True, False, True, False]
    assert events.token_bucket_table(case.limit(0), 2.0, 1.0).count() == 0
