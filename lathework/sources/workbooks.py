"""Metadata of workbooks (XML) as tables, read by Spark's own XML functions. Formulas stay text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(texts: str, **nested: T.DataType) -> T.StructType:
    """A struct of text fields (attributes begin with _) and of nested ones, whose names have hyphens for underscores."""
    fields = [T.StructField(name, T.StringType()) for name in texts.split()]
    return T.StructType(fields + [T.StructField(name.replace("_", "-"), kind) for name, kind in nested.items()])


_COLUMN = _struct(
    "_name _caption _datatype _role _type _ordinal _value",
    calculation=_struct("_class _formula", table_calc=T.ArrayType(_struct("_type"))),
    aliases=_struct("", alias=T.ArrayType(_struct("_key _value"))),
)
_RELATION = _struct("_name _table _type _connection", columns=_struct("", column=T.ArrayType(_COLUMN)))
_INNER = _struct("_class _caption _name _dbname _server", relation=T.ArrayType(_RELATION))
_NAMED = _struct("_caption _name", connection=T.ArrayType(_INNER))
_RECORD = _struct("_class remote-name local-name parent-name local-type aggregation")
_CONNECTION = _struct(
    "_class _caption _name _dbname _server",
    relation=T.ArrayType(_RELATION),
    named_connections=_struct("", named_connection=T.ArrayType(_NAMED)),
    metadata_records=_struct("", metadata_record=T.ArrayType(_RECORD)),
)
_SOURCE = _struct("_name _caption _version", column=T.ArrayType(_COLUMN), connection=T.ArrayType(_CONNECTION))
#: What is read of a workbook; elements and attributes beyond it are passed over.
SCHEMA = _struct("", datasources=_struct("", datasource=T.ArrayType(_SOURCE)))


def workbook_files(spark: SparkSession, folder: str, pattern: str = "*.twb") -> DataFrame:
    """path, xml of the workbook files below a folder, a file a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, xml): of each package the workbook nearest to its root, of several the one with the shortest name; null for a package that is none."""
    for batch in batches:
        out = []
        for content in batch.column("content"):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as package:
                    name = min((n for n in package.namelist() if n.lower().endswith(".twb")), key=lambda n: (n.count("/"), len(n)), default=None)
                    out.append(package.read(name).decode("utf-8", "replace") if name else None)
            except zipfile.BadZipFile:
                out.append(None)
        yield pa.record_batch([batch.column("path"), pa.array(out, pa.string())], ["path", "xml"])


def packed_workbook_files(spark: SparkSession, folder: str, pattern: str = "*.twbx") -> DataFrame:
    """path, xml of the packed workbooks below a folder: of each package the workbook that is nearest to its root. xml is null for a package without one.

    Files are read and unpacked where they lie, one after the other in a task; a package is in memory as a whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(_unpacked, "path string, xml string")


def datasources(workbooks: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """key, nth (from 0), name, caption, version, source (all that was read) of each datasource. Broken or null XML has none."""
    read = workbooks.select(key, F.from_xml(F.col(xml), SCHEMA, {"mode": "PERMISSIVE"}).alias("_w"))
    each = read.select(key, F.posexplode("_w.datasources.datasource").alias("nth", "source"))
    return each.select(key, "nth", F.col("source._name").alias("name"), F.col("source._caption").alias("caption"), F.col("source._version").alias("version"), "source")


def _column(c: str) -> list[Column]:
    """What is told of a column, from its struct."""
    at = lambda name: F.col(f"{c}.{name}")
    key_value = F.transform(at("aliases.alias"), lambda x: F.struct(x["_key"].alias("key"), x["_value"].alias("value")))
    return [
        *(at(f"_{n}").alias(n) for n in ("name", "caption", "datatype", "role", "type")), at("_ordinal").try_cast("int").alias("ordinal"), at("_value").alias("value"), at("calculation._formula").alias("formula"),
        at("calculation._class").alias("calculation_class"), (F.size(F.coalesce(at("calculation.table-calc"), F.array().cast("array<struct<_type:string>>"))) > 0).alias("has_table_calc"), key_value.alias("aliases"),
    ]


def source_columns(sources: DataFrame, key: str) -> DataFrame:
    """key, source, nth and what is told of each column of datasources(); the formula of a calculated one is text, aliases are an array (null without)."""
    each = sources.select(key, F.col("name").alias("source"), F.posexplode("source.column").alias("nth", "c"))
    return each.select(key, "source", "nth", *_column("c"))


def connections(sources: DataFrame, key: str) -> DataFrame:
    """key, source, class, caption, name, dbname, server, relations of each connection: the datasource's own, named ones and those inside of them."""
    told = lambda c, name: c[f"_{name}"].alias(name)
    facts = ("class", "caption", "name", "dbname", "server")
    one = lambda c: F.struct(*(told(c, n) for n in facts), c["relation"].alias("relations"))
    none = F.lit(None).cast("string")
    named = lambda c: F.struct(none.alias("class"), told(c, "caption"), told(c, "name"), none.alias("dbname"), none.alias("server"), F.lit(None).cast(T.ArrayType(_RELATION)).alias("relations"))
    inside = lambda c: F.concat(F.array(named(c)), F.transform(F.coalesce(c["connection"], F.array().cast(T.ArrayType(_INNER))), one))
    below = lambda c: F.flatten(F.transform(F.coalesce(c["named-connections"]["named-connection"], F.array().cast(T.ArrayType(_NAMED))), inside))
    all_ = F.flatten(F.transform("source.connection", lambda c: F.concat(F.array(one(c)), below(c))))
    return sources.select(key, F.col("name").alias("source"), F.explode(all_).alias("c")).select(key, "source", "c.*")


def relations(sources: DataFrame, key: str) -> DataFrame:
    """key, source, name, table, type, connection, columns (their names) of each relation of each connection."""
    each = connections(sources, key).select(key, "source", F.explode("relations").alias("r"))
    names = F.transform(F.coalesce(F.col("r.columns.column"), F.array().cast(T.ArrayType(_COLUMN))), lambda c: c["_name"])
    return each.select(key, "source", *(F.col(f"r._{n}").alias(n) for n in ("name", "table", "type", "connection")), names.alias("columns"))


def metadata_records(sources: DataFrame, key: str) -> DataFrame:
    """key, source, class, remote_name, local_name, parent_name, local_type, aggregation of each record on a field."""
    each = sources.select(key, F.col("name").alias("source"), F.explode("source.connection").alias("c")).select(key, "source", F.explode("c.metadata-records.metadata-record").alias("r"))
    names = ("remote-name", "local-name", "parent-name", "local-type", "aggregation")
    return each.select(key, "source", F.col("r._class").alias("class"), *(F.col(f"r.`{n}`").alias(n.replace("-", "_")) for n in names))
