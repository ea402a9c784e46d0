"""A queue of numbered messages as a streaming source, and a sink in which a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "number long, body string"


class Queue(Protocol):
    """What the source asks of a queue's client. It travels to tasks, so it must be picklable (open connections lazily)."""

    def bounds(self) -> tuple[int, int]:
        """The number of the first message that is still there, and the number that the next one sent will get."""

    def read(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        """(number, body) of the messages from start up to, not including, end. They stay in the queue."""

    def delete(self, end: int) -> None:
        """Deletes all messages below end. Asked for those of a range once it is committed, perhaps more than once."""


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, queue: Queue, each: int):
        self.queue, self.each = queue, each

    def initialOffset(self) -> dict:
        return {"next": self.queue.bounds()[0]}

    def latestOffset(self) -> dict:
        return {"next": self.queue.bounds()[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(at, min(at + self.each, end["next"])) for at in range(start["next"], end["next"], self.each)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.queue.read(partition.start, partition.end)

    def commit(self, end: dict) -> None:
        self.queue.delete(end["next"])


def queue_stream(spark: SparkSession, queue: Queue, name: str = "lathework_queue", each: int = 1000) -> DataFrame:
    """A stream (number, body) of a queue's messages, from the first that is there.

    Offsets are message numbers, kept in the stream's checkpoint; a batch is cut into ranges of `each` messages, which tasks read side by side.
    Messages are deleted when the batch after theirs is planned, so a restart finds all that an unfinished batch needs.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(queue, each)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def recorded(path: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: writes work(batch) under the batch's number.

    A batch that comes again after a failure replaces what it wrote before, so each message counts once, whatever
    the failure left. work must give the same for the same messages. Read the results with recorded_rows().
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def recorded_rows(spark: SparkSession, path: str) -> DataFrame:
    """What recorded() has written, with the number of each row's batch. Batches that a failure cut short are left out."""
    return spark.read.parquet(path)


def job_states(messages: DataFrame) -> DataFrame:
    """number, job, kind, state of messages whose body is JSON with job and kind: queued, or failed for a body without them.

    A message that can't be read is taken from the queue like any other; its row says so.
    """
    told = F.from_json("body", "job string, kind string")
    read = messages.select("number", told.alias("_t"))
    whole = F.col("_t.job").isNotNull() & F.col("_t.kind").isNotNull()
    return read.select("number", F.col("_t.job").alias("job"), F.col("_t.kind").alias("kind"), F.when(whole, "queued").otherwise("failed").alias("state"))
