"""Metrics named in texts, and those that don't agree across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import metric_format, metric_label, metric_pairs, metric_value


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, value, metric (label in its normal form), amount, format: a row for each mention."""
    found = docs.select(F.col(id_col), F.explode(metric_pairs(F.col(text_col))).alias("p")).select(id_col, "p.*")
    return found.select("*", metric_label(F.col("label")).alias("metric"), metric_value(F.col("value")).alias("amount"), metric_format(F.col("value")).alias("format"))


def inconsistent(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Metrics mentioned twice or more with several amounts or formats."""
    grouped = mentions.groupBy("metric").agg(
        F.count("*").alias("mentions"),
        F.count_distinct(id_col).alias("documents"),
        F.count_distinct("amount").alias("amounts"),
        F.count_distinct("format").alias("formats"),
    )
    return grouped.filter("mentions >= 2 and (amounts > 1 or formats > 1)")
