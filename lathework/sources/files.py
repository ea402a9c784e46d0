"""Sources and sinks: tables, text files, corpora of binary files, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """With a header. A schema saves the pass that infers one."""
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def records(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows of the driver."""
    return spark.createDataFrame(rows, schema)


def columns(spark: SparkSession, data: dict[str, list], schema: str) -> DataFrame:
    """A few rows of the driver, given as lists of equal length by column."""
    return spark.createDataFrame(list(zip(*data.values(), strict=True)), schema).toDF(*data)


#: Suffixes of files and how they are read.
READERS = {"csv": lambda reader: reader.option("header", True).csv, "json": lambda reader: reader.json, "parquet": lambda reader: reader.parquet, "txt": lambda reader: reader.text, "md": lambda reader: reader.text}


def by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reads a path by its suffix; an unknown one is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}")
    return READERS[suffix](spark.read.schema(schema) if schema else spark.read)(path)


def tagged(df: DataFrame, key: str, tag: str) -> DataFrame:
    """key and body: each row as JSON under its type's tag; nulls are left out."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(F.lit(tag).alias("__type__"), *rest)).alias("body"))


def untagged(bodies: DataFrame, key: str, tag: str, schema: str) -> DataFrame:
    """The rows of one tag from their JSON; other tags and broken bodies are left out."""
    read = bodies.select(key, F.from_json("body", f"__type__ string, {schema}").alias("_x")).filter(F.col("_x.__type__") == tag)
    return read.select(key, "_x.*").drop("__type__")


def bundle(elements: DataFrame, path: str, page: str) -> None:
    """The elements and a summary of how many each page has, side by side."""
    elements.write.mode("overwrite").parquet(f"{path}/elements")
    elements.groupBy(page).agg(F.count("*").alias("elements")).write.mode("overwrite").json(f"{path}/summary")


def latest_sink(path: str, key: str, at: str):
    """For writeStream.foreachBatch: keeps the last row of each key. Each batch adds its own last rows as a file of its
    number (a batch that comes again replaces its own), so nothing is read; latest_of() reads them."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("_r")).select("_r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_of(spark: SparkSession, path: str, key: str, at: str) -> DataFrame:
    """What latest_sink() has kept: the last row of each key over all batches."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("_r")).select("_r.*")


def corpus(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".pptx", ".pdf")) -> DataFrame:
    """path, kind, length of a folder's files with these suffixes, at any depth; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("kind", kind).filter(F.col("kind").isin(*suffixes))


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database's table, read in ranges of a key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as lines of a Markdown table. With an order the files, read by name, are one table in that order under its header; else there are lines alone, in
    as many files as df has partitions."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    lines = df.select(line(cells).alias("value"), *(F.col(c) for c in order or []))
    if order:
        head = df.sparkSession.range(2).select(F.when(F.col("id") == 0, line([F.lit(c) for c in df.columns])).otherwise(line([F.lit("---")] * len(df.columns))).alias("value"), F.col("id").alias("_top"))
        lines = head.unionByName(lines.withColumn("_top", F.lit(2).cast("long")), allowMissingColumns=True).orderBy("_top", *order)
    lines.select("value").write.mode("overwrite").text(path)


def extract(df: DataFrame, path: str, category: str | None = None) -> None:
    """Parquet for other tools: with a category column in long form (category, series, value), else as it is."""
    from ..operators.reshape import melt

    (melt(df, category) if category else df).write.mode("overwrite").parquet(path)
