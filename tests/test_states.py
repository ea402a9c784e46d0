"""State with timers and the queue source on real streams: late rows, restarts, batches that come again; each beside its twin over a table."""

import datetime
import json
import os
import random
import sys

import pytest
from lathework.sources import queues
from lathework.streaming import states
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tests' queue travels to tasks

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "key long, event_id long, ts timestamp, value string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Stream:
    """Micro-batches of (key, event_id, seconds, value), one file each; run() takes those added since the last run, from the checkpoint."""

    def __init__(self, spark, folder, function):
        self.spark, self.folder, self.function, self.n = spark, folder, function, 0

    def add(self, *batches):
        for batch in batches:
            rows = [(k, i, START + datetime.timedelta(seconds=s), v) for k, i, s, v in batch]
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.folder}/in/{self.n:04d}")
            self.n += 1

    def run(self):
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.folder}/in")
        query = self.function(source).writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/check").foreachBatch(queues.recorded(f"{self.folder}/out", lambda b: b)).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return [tuple(r) for r in queues.recorded_rows(self.spark, f"{self.folder}/out").drop("batch").collect()]


def table_of(spark, rows):
    return spark.createDataFrame([(k, i, START + datetime.timedelta(seconds=s), v) for k, i, s, v in rows], SCHEMA)


def plain_limit(rows, capacity, rate, window, most):
    state, out = {}, []
    for key, event, at, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        tokens, last, over = state.get(key, (capacity, at, []))
        tokens = min(capacity, tokens + (at - last) * rate)
        ok = tokens >= 1
        over = over if ok else [x for x in [*over, at] if x >= at - window]
        state[key] = (tokens - ok, at, over)
        out.append((key, event, ok, len(over), len(over) >= most))
    return sorted(out)


def test_limits_over_restarts(rocks, tmp_path):
    rng = random.Random(7)
    times = sorted(rng.randrange(0, 4000) / 8 for _ in range(90))
    rows = [(rng.randrange(3), i, t, None) for i, t in enumerate(times)]
    rows += [(0, 900 + i, 9000 + i / 4, None) for i in range(8)]  # after the state of all keys has gone by its timer
    want = plain_limit(rows, 2.0, 0.25, 20.0, 2)
    assert {w[2] for w in want} == {w[4] for w in want} == {True, False}
    stream = Stream(rocks, tmp_path, lambda s: states.limited(s, 2.0, 0.25, 20.0, 2))
    stream.add(rows[:30], rows[30:60])
    stream.run()
    stream.add(rows[60:90], rows[90:], [(1, 999, 1.0, None)])  # the last comes hours late
    assert sorted(stream.run()) == want
    twin = states.limited_table(table_of(rocks, [*rows, (None, 5, 1, None)]), 2.0, 0.25, 20.0, 2)
    assert sorted(map(tuple, twin.collect())) == want


def plain_saves(rows, every):
    out = []
    for key in {r[0] for r in rows}:
        mine, last, first = sorted((s, i, v) for k, i, s, v in rows if k == key), object(), True
        while mine:
            due = mine[0][0] + every
            now = [x for x in mine if x[0] <= due]
            if now[-1][2] != last:
                out.append((key, START + datetime.timedelta(seconds=due), now[-1][2]))
            last, mine = now[-1][2], mine[len(now) :]
    return sorted(out, key=str)


def test_saves_by_timer_over_restarts(rocks, tmp_path):
    rows = [(1, 1, 0.0, "a"), (1, 2, 3.0, "b"), (2, 3, 4.0, "x"), (1, 4, 5.0, "c"), (1, 5, 5.5, "d"), (1, 6, 9.0, "c"), (2, 7, 30.0, "x"), (2, 8, 36.0, "y"), (1, 9, 40.0, None), (1, 10, 46.0, None), (1, 11, 60.0, "z")]
    assert len(plain_saves(rows, 5.0)) == 5  # key 1 saves c at 5, at 10.5 the same again, null at 45, at 51 the same again, z; key 2 x, the same again, y
    stream = Stream(rocks, tmp_path, lambda s: states.saved(s, every=5.0, late="10 seconds"))
    stream.add(rows[:4], rows[4:7])
    stream.run()
    stream.add(rows[7:], [(3, 90, 500.0, "end")], [(1, 91, 2.0, "late")], [(3, 92, 501.0, "end")], [(3, 93, 502.0, "end")])
    got = [(k, at.replace(tzinfo=datetime.UTC), v) for k, at, v in stream.run()]
    assert sorted((g for g in got if g[0] != 3), key=str) == plain_saves(rows, 5.0)
    twin = states.saved_table(table_of(rocks, [*rows, (None, 5, 1, "n")]), every=5.0).collect()
    assert sorted(((r.key, r.saved_at.replace(tzinfo=datetime.UTC), r.value) for r in twin), key=str) == plain_saves(rows, 5.0)


def test_saves_of():
    changes = [(0.0, "a"), (2.0, "b"), (7.0, "b"), (9.0, "c")]
    assert states.saves_of(changes, 5.0, None, 4.0) == ([], changes)
    assert states.saves_of(changes, 5.0, "b", 6.0) == ([(5.0, "b", False)], changes[2:])
    assert states.saves_of(changes, 5.0, None, 99.0) == ([(5.0, "b", True), (12.0, "c", True)], [])


class FolderQueue:
    """A queue for tests: a message is a file named by its number, in a folder that driver and tasks see; deleted ones leave the count."""

    def __init__(self, folder):
        self.folder = str(folder)

    def _numbers(self):
        return sorted(int(n) for n in os.listdir(self.folder) if n.isdigit())

    def _end(self):
        with open(f"{self.folder}/end") as f:
            return int(f.read())

    def send(self, *bodies):
        end = self._end() if os.path.exists(f"{self.folder}/end") else 0
        for body in bodies:
            with open(f"{self.folder}/{end}", "w") as f:
                f.write(body)
            end += 1
        with open(f"{self.folder}/end", "w") as f:
            f.write(str(end))

    def bounds(self):
        there = self._numbers()
        return (there[0] if there else self._end()), self._end()

    def read(self, start, end):
        for n in range(start, end):
            with open(f"{self.folder}/{n}") as f:
                yield n, f.read()

    def delete(self, end):
        for n in self._numbers():
            if n < end:
                os.remove(f"{self.folder}/{n}")


def test_queue_survives_a_killed_stream(spark, tmp_path):
    (tmp_path / "queue").mkdir()
    queue = FolderQueue(tmp_path / "queue")
    message = lambda i: json.dumps({"job": f"j{i}", "kind": "pptx"})
    queue.send(*(message(i) for i in range(5)), "not json")
    write = queues.recorded(str(tmp_path / "out"), queues.job_states)

    def run(fail):
        def each(batch, number):
            write(batch, number)
            if fail:
                raise RuntimeError("killed after the rows were written, before the batch counts as done")

        stream = queues.queue_stream(spark, queue, f"queue_{'fails' if fail else 'runs'}", each=2)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(each).trigger(processingTime="0 seconds").start()
        try:
            if fail:
                with pytest.raises(Exception, match="killed"):
                    query.awaitTermination(120)
            else:
                query.processAllAvailable()
                queue.send(message(6), message(7))
                query.processAllAvailable()
        finally:
            query.stop()

    run(fail=True)
    assert queue.bounds() == (0, 6)  # nothing is deleted before its batch is done
    run(fail=False)
    got = queues.recorded_rows(spark, str(tmp_path / "out")).orderBy("number").collect()
    assert [(r.number, r.job, r.state) for r in got] == [*((i, f"j{i}", "queued") for i in range(5)), (5, None, "failed"), (6, "j6", "queued"), (7, "j7", "queued")]
    assert queue.bounds()[0] >= 6  # what is done is deleted


def test_job_states(spark):
    rows = spark.createDataFrame([(1, '{"job":"a","kind":"pdf"}'), (2, '{"job":"a"}'), (3, None), (4, "")], "number long, body string")
    assert [r.state for r in queues.job_states(rows).orderBy("number").collect()] == ["queued", "failed", "failed", "failed"]
