"""Tables written in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is named and one machine runs all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lathework-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    Lineage ends here: a lost executor costs no recomputation of what came before, and the planner
    knows the table's real size when it picks a join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lathework-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _paths(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def remove(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing needs any more."""
    for path in _paths(df):
        _remove(df.sparkSession, path)


#: The tables written inside each scratch() that is open, the innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written inside once it ends, but for those passed to the function that it gives."""
    made: list[str] = []
    kept: set[str] = set()
    _open.append(made)

    def keep(*tables: DataFrame) -> None:
        for df in tables:
            kept.update(p.rsplit("/", 1)[-1] for p in _paths(df))

    try:
        yield keep
    finally:
        _open.remove(made)
        for path in made:
            if path.rsplit("/", 1)[-1] not in kept:
                _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on Arrow batches that the session sends to Python have about `size` bytes, unless it has a bound of its own.

    A batch is held by the executor and by its worker at once; without a bound it has 10,000 rows, however long.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(size))
