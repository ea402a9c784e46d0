"""Clusters of elements on pages: by structure, by skeleton, by nearness, on grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(elements: DataFrame, group: str, tallies: dict[str, Column] | None = None) -> DataFrame:
    """The box around each group's elements (x, y, w, h), how many there are, and how many of each tally."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    counted = [F.count_if(flag).alias(name) for name, flag in (tallies or {}).items()]
    return elements.groupBy(group).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(right).alias("x1"), F.max(bottom).alias("y1"), F.count("*").alias("members"), *counted)


def multiset_groups(parts: DataFrame, owner: str, kind: str, sizes: tuple[int, int], least: int = 2) -> DataFrame:
    """Owners with the same kinds of parts, each as often: signature, members, prototype (smallest owner).

    Owners with fewer or more parts than `sizes` and groups of fewer than `least` owners are left out. Kinds are
    counted before they are listed, so an owner of very many parts is a few rows.
    """
    per_kind = parts.groupBy(owner, kind).agg(F.count("*").alias("_n"))
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(kind, "_n"))), lambda x: F.array_repeat(x[kind], x["_n"].cast("int"))))
    per_owner = per_kind.groupBy(owner).agg(F.sum("_n").alias("_parts"), F.array_join(listed, "|").alias("signature")).filter(F.col("_parts").between(*sizes))
    return per_owner.groupBy("signature").agg(F.count("*").alias("members"), F.min(owner).alias("prototype")).filter(F.col("members") >= least)


def repeated(elements: DataFrame, kind: str, page: str, id_col: str, least_width: float = 0.5, least: int = 2, step: float = 0.5) -> DataFrame:
    """kind, qw, qh (width and height on a grid), repeats, pages, prototype of elements that occur `least` times or more; narrow ones don't count."""
    on_grid = lambda c: F.bround(F.col(c) / step, 0).cast("int")
    grouped = elements.filter(F.col("w") >= least_width).groupBy(kind, on_grid("w").alias("qw"), on_grid("h").alias("qh"))
    return grouped.agg(F.count("*").alias("repeats"), F.count_distinct(page).alias("pages"), F.min(id_col).alias("prototype")).filter(F.col("repeats") >= least)


def candidates(groups: DataFrame, whole: int, top: int) -> DataFrame:
    """The largest groups with a confidence: members over `whole`, 1 at most."""
    ranked = groups.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("members") / whole), 6))
    return ranked.orderBy(F.desc("members"), "prototype").limit(top)


def skeleton(kind: Column, box: list[Column], step: float = 0.5) -> Column:
    """A kind with its box on a grid (halves go to the even line)."""
    x, y, w, h = (F.bround(c / step, 0).cast("int").cast("string") for c in box)
    return F.concat(kind, F.lit("@"), x, F.lit(","), y, F.lit("#"), w, F.lit("x"), h)


def twins(elements: DataFrame, owner: str, kind: str, box: list[str], looks: dict[str, Column], axes: tuple[int, int] = (1, 12), step: float = 0.5) -> DataFrame:
    """Owners of one skeleton: skeleton, members, first, and axes: in how many looks (aggregates of an owner) they vary.

    Groups with fewer or more varying looks than `axes` are left out.
    """
    on_grid = [F.bround(F.col(c) / step, 0) for c in box]
    placed = elements.withColumn("_part", F.struct(F.col(kind), *(g.alias(f"_{c}") for g, c in zip(on_grid, box, strict=True)), skeleton(F.col(kind), [F.col(c) for c in box], step).alias("_text")))
    names = list(looks)
    per_owner = placed.groupBy(owner).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_part")), lambda p: p["_text"]), "|").alias("skeleton"), *(looks[n].alias(n) for n in names))
    differ = sum(((F.min(n) < F.max(n)).cast("int") for n in names), F.lit(0))
    grouped = per_owner.groupBy("skeleton").agg(F.count("*").alias("members"), F.min(owner).alias("first"), differ.alias("axes"))
    return grouped.filter(F.col("axes").between(*axes))


def grids(cells: DataFrame, page: str, least: int = 2, fill: float = 0.65, tolerance: float = 5.0) -> DataFrame:
    """page, columns, rows, cells, fill, is_table: whether a page's boxes form a grid, filled well and with even column widths."""
    shape = cells.groupBy(page).agg(F.count_distinct("x").alias("columns"), F.count_distinct("y").alias("rows"), F.count_distinct("x", "y").alias("cells"))
    widths = cells.groupBy(page, "x").agg((F.max("w") - F.min("w")).alias("_spread")).groupBy(page).agg((F.max("_spread") <= 2 * tolerance).alias("_even"))
    share = F.col("cells") / (F.col("columns") * F.col("rows"))
    is_table = (F.col("columns") >= least) & (F.col("rows") >= least) & (F.col("cells") >= fill * F.col("columns") * F.col("rows")) & F.col("_even")
    return shape.join(widths, page).select(page, "columns", "rows", "cells", share.alias("fill"), is_table.alias("is_table"))


def gap_columns(rows: DataFrame, page: str, x: str, gap: float) -> DataFrame:
    """page, col, x0, x1, starts: distinct positions of each page in columns, cut where they lie more than `gap` apart."""
    order = Window.partitionBy(page).orderBy(x)
    distinct = rows.select(page, F.col(x).cast("double").alias(x)).distinct()
    jumps = distinct.withColumn("_jump", F.coalesce(F.col(x) - F.lag(x).over(order) > gap, F.lit(False)).cast("int"))
    numbered = jumps.withColumn("col", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(page, "col").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.count("*").alias("starts"))
