"""Worksheets: a dimension and up to three measures, fixed levels of detail, calculations over the shown table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Aggregate codes of worksheet shelves; unknown codes sum.
AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "average": F.avg,
    "min": F.min,
    "max": F.max,
    "cnt": F.count,
    "countd": F.count_distinct,
    "med": F.median,
    "var": F.var_samp,
    "stdev": F.stddev_samp,
}
#: These answer from sketches of bounded size, within a few per cent.
APPROXIMATE = {"countd": F.approx_count_distinct, "med": lambda c: F.percentile_approx(c, 0.5)}
MOST_MEASURES, RANKED_ROWS, AXIS_ROWS = 3, 10, 36


@dataclass(frozen=True)
class Measure:
    name: str
    of: Column
    aggregate: str = "sum"
    approximate: bool = False

    @property
    def column(self) -> Column:
        if self.approximate and self.aggregate.lower() in APPROXIMATE:
            return APPROXIMATE[self.aggregate.lower()](self.of).alias(self.name)
        return AGGREGATES.get(self.aggregate.lower(), F.sum)(self.of).alias(self.name)


def worksheet(df: DataFrame, dimension: Column, measures: list[Measure], name: str = "category", ranked: bool = True, rows: int | None = None) -> DataFrame:
    """A ranked bar (the largest first measures first) or an axis (categories in order).

    Null categories go before grouping; rows whose first measure is null go after the limit. Equal
    measures stand in order of category.
    """
    if not 1 <= len(measures) <= MOST_MEASURES:
        raise ValueError(f"a worksheet has 1 to {MOST_MEASURES} measures")
    first = measures[0].name
    shown = df.filter(dimension.isNotNull()).groupBy(dimension.alias(name)).agg(*(m.column for m in measures))
    order = [F.desc_nulls_last(first), F.asc(name)] if ranked else [F.asc_nulls_last(name)]
    return shown.orderBy(*order).limit(rows or (RANKED_ROWS if ranked else AXIS_ROWS)).filter(F.col(first).isNotNull())


MOST_SKETCHED, SKETCH_ROWS = 6, 100


def sketch(df: DataFrame, dimensions: list[Column], measures: list[Measure]) -> DataFrame:
    """The first six dimensions grouped with the first six measures; without either, a hundred rows as they come."""
    if not dimensions and not measures:
        return df.limit(SKETCH_ROWS)
    shown = [m.column for m in measures[:MOST_SKETCHED]]
    grouped = df.groupBy(*dimensions[:MOST_SKETCHED])
    return grouped.agg(*shown) if shown else df.select(*dimensions[:MOST_SKETCHED]).distinct()


#: How aggregates of parts are aggregated for the whole, where they can be.
MERGED = {"sum": "sum", "min": "min", "max": "max", "cnt": "sum"}


def with_totals(df: DataFrame, dimensions: list[str], measures: list[Measure], cube: bool = False) -> DataFrame:
    """Subtotals over the dimensions from the right, or over each subset of them; grouping_level tells which.

    If all measures can be merged (sums, counts, least and greatest values), rows are aggregated at the finest level first, and only these
    few are expanded to all levels.
    """
    if all(m.aggregate.lower() in MERGED for m in measures):
        df = df.groupBy(*dimensions).agg(*(m.column for m in measures))
        measures = [Measure(m.name, F.col(m.name), MERGED[m.aggregate.lower()]) for m in measures]
    grouped = df.cube(*dimensions) if cube else df.rollup(*dimensions)
    return grouped.agg(*(m.column for m in measures), F.grouping_id().cast("int").alias("grouping_level"))


def with_fixed(df: DataFrame, keys: list[str], *measures: Measure) -> DataFrame:
    """Each row with the measures over all rows of its keys, whatever else is shown. Null keys are a group."""
    fixed = df.groupBy(*keys).agg(*(m.column for m in measures))
    renamed = fixed.select(*(F.col(k).alias(f"_{k}") for k in keys), *(m.name for m in measures))
    same = [df[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return df.join(renamed, same, "left").drop(*(f"_{k}" for k in keys))


def with_included(df: DataFrame, shown: list[str], further: list[str], measure: Measure, outer: Measure) -> DataFrame:
    """A finer level than is shown: the measure by the shown and further keys, then the outer aggregate of it by the shown keys."""
    return df.groupBy(*shown, *further).agg(measure.column).groupBy(*shown).agg(outer.column)


def with_excluded(df: DataFrame, shown: list[str], without: list[str], measure: Measure, excluded: Measure) -> DataFrame:
    """The measure by the shown keys beside the other one by those of them that are not left out."""
    kept = [k for k in shown if k not in without]
    coarse = df.groupBy(*kept).agg(excluded.column).select(*(F.col(k).alias(f"_{k}") for k in kept), excluded.name)
    fine = df.groupBy(*shown).agg(measure.column)
    joined = fine.join(coarse, [fine[k].eqNullSafe(coarse[f"_{k}"]) for k in kept], "left") if kept else fine.join(F.broadcast(coarse))
    return joined.drop(*(f"_{k}" for k in kept))


def members(column: Column, rule: dict) -> Column:
    """A worksheet filter over members, which may nest: {"member": v}, {"union": [...]}, {"except": [all, without]},
    {"range": (low, high)}, {"all": True}. A range without an end is open there; null members are only in "all"."""
    (kind, of), *_ = rule.items()
    if kind == "member":
        return F.coalesce(column == of, F.lit(False))
    if kind == "union":
        return reduce(Column.__or__, (members(column, r) for r in of), F.lit(False))
    if kind == "except":
        return members(column, of[0]) & ~members(column, of[1])
    if kind == "range":
        low, high = of
        return F.coalesce((F.lit(True) if low is None else column >= low) & (F.lit(True) if high is None else column <= high), F.lit(False)) & column.isNotNull()
    if kind == "all":
        return F.lit(True)
    raise ValueError(f"unknown filter {kind}")


def top_in_context(df: DataFrame, context: Column, dimension: Column, measure: Measure, top: int) -> DataFrame:
    """The rows of the context filter whose dimension is among its `top` by the measure: the filter works before the ranking."""
    inside = df.filter(context)
    best = inside.filter(dimension.isNotNull()).groupBy(dimension.alias("_best")).agg(measure.column).orderBy(F.desc_nulls_last(measure.name), "_best").limit(top)
    return inside.join(F.broadcast(best.select("_best")), dimension == F.col("_best"), "left_semi")


def looked_up(table: DataFrame, value: str, order: list[Column], within: list[str], away: int) -> DataFrame:
    """Adds what the window has: the value so many rows on (or back), its least, sum and mean, and the row's percentile rank."""
    whole = Window.partitionBy(*within)
    v, ordered = F.col(value), whole.orderBy(*order)
    at = F.lead(v, away).over(ordered) if away >= 0 else F.lag(v, -away).over(ordered)
    return table.select("*", at.alias("looked_up"), F.min(v).over(whole).alias("window_min"), F.sum(v).over(whole).alias("window_sum"), F.min(v).over(ordered.rowsBetween(-1, 1)).alias("near_min"), F.percent_rank().over(whole.orderBy(v)).alias("percentile"))


def table_calculations(table: DataFrame, value: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Adds what worksheets calculate over the shown rows of each partition: running totals, shares, ranks, neighbours.

    The table is an aggregated one. `order` must be total within a partition, or the result isn't defined.
    """
    whole = Window.partitionBy(*(within or []))
    ordered = whole.orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    before = F.lag(v).over(ordered)
    return table.select(
        "*",
        F.row_number().over(ordered).alias("index"),
        (1 - F.row_number().over(ordered)).alias("first"),
        (F.count("*").over(whole) - F.row_number().over(ordered)).cast("int").alias("last"),
        F.count("*").over(whole).alias("size"),
        F.sum(v).over(so_far).alias("running_sum"),
        F.avg(v).over(ordered.rowsBetween(-2, 0)).alias("moving_avg"),
        F.max(v).over(so_far).alias("running_max"),
        F.rank().over(whole.orderBy(v.desc_nulls_last())).alias("rank"),
        F.try_divide(v, F.sum(v).over(whole)).alias("share"),
        before.alias("previous"),
        F.lead(v).over(ordered).alias("next"),
        F.try_divide(v - before, F.abs(before)).alias("difference"),
    )


def shelf_sorted(df: DataFrame, dimension: str, measure: str | None = None, direction: str | None = None) -> DataFrame:
    """Sorted as a shelf is: by the measure if there is one, else by the dimension; ascending unless the direction is DESC, nulls last. Equal measures stand by dimension."""
    by = measure or dimension
    first = F.desc_nulls_last(by) if (direction or "ASC").upper() == "DESC" else F.asc_nulls_last(by)
    return df.orderBy(first, dimension) if measure else df.orderBy(first)
