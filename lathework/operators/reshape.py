"""Wide and long forms of chart data, refreshes, stacked shares, category levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(wide: DataFrame, category: str, series: list[str] | None = None, names: str = "series", values: str = "value") -> DataFrame:
    """A row for each category and series; the category column becomes `category`."""
    series = series or [c for c in wide.columns if c != category]
    doubles = wide.select(F.col(category).cast("string").alias("category"), *(F.col(c).cast("double").alias(c) for c in series))
    return doubles.unpivot("category", series, names, values)


def spread(long: DataFrame, category: str, series: str, value: str, names: list) -> DataFrame:
    """A column for each named series; naming them saves a pass over the data. A missing value is null."""
    return long.groupBy(category).pivot(series, names).agg(F.first(value, ignorenulls=True))


def refresh_series(formats: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """Chart series after new data: data(keys, idx, name, values) with the format of the same place in formats(keys, idx, format).

    Series beyond the old ones take the last one's format; old ones beyond the new are gone; null values become 0.
    """
    last = formats.groupBy(*keys).agg(F.max("idx").alias("_last"))
    at = data.join(last, keys, "left").withColumn("_at", F.least("idx", "_last"))
    joined = at.join(formats.select(*keys, F.col("idx").alias("_at"), "format"), [*keys, "_at"], "left")
    return joined.select(*keys, "idx", "name", F.transform("values", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("values"), "format")


def stacked_shares(long: DataFrame, category: str = "category", value: str = "value") -> DataFrame:
    """Each value's share of its category; of a category that sums to 0, the value itself."""
    total = F.sum(value).over(Window.partitionBy(category))
    return long.withColumn("share", F.col(value) / F.when(total == 0, 1).otherwise(total))


def series_offsets(series: DataFrame, n: str = "n", idx: str = "idx", chart: str | None = None) -> DataFrame:
    """Where each series' block begins in a sheet of stacked blocks: two rows apart and after all points before."""
    before = Window.partitionBy(*([chart] if chart else [])).orderBy(idx)
    return series.withColumn("row_offset", 2 * (F.row_number().over(before) - 1) + F.coalesce(F.sum(n).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def padded(rows: DataFrame, cells: str, width: int) -> DataFrame:
    """Ragged rows filled with empty text up to a width."""
    return rows.withColumn(cells, F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells)))))


def pasted_series(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines "name<tab or comma>value..." as name and values; $ and commas between digits go, what is no finite number is null.

    A line without a second cell is left out.
    """
    cells = F.transform(F.split(text, r"\t|,(?!\d{3}(?:\D|$))"), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    number = lambda c: F.regexp_replace(c, "[$,]", "").try_cast("double")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = lines.withColumn("_cells", cells).filter(F.size("_cells") >= 2)
    rest = F.slice("_cells", F.lit(2), F.size("_cells") - 1)
    return out.select(F.get("_cells", F.lit(0)).alias("name"), F.transform(rest, lambda c: finite(number(c))).alias("values"))


def shares(long: DataFrame, value: str, of: list[str], name: str = "share") -> DataFrame:
    """Each value's share of the sum over its group, or over all rows if `of` is empty; 0 where that sum is 0 or null.

    Sums are joined, so that neither one group's rows nor all rows meet in a task.
    """
    total = long.groupBy(*of).agg(F.sum(value).alias("_total"))
    joined = long.join(total.select(*(F.col(c).alias(f"_{c}") for c in of), "_total"), [long[c].eqNullSafe(F.col(f"_{c}")) for c in of], "left") if of else long.join(F.broadcast(total))
    return joined.withColumn(name, F.coalesce(F.try_divide(F.col(value), F.col("_total")), F.lit(0.0))).drop("_total", *(f"_{c}" for c in of))
