"""Logs with an order: undo and redo as sums, and rows that stay unless an earlier one that stayed has their key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import settled


def undone(log: DataFrame, key: str, order: list[str], op: str) -> DataFrame:
    """The log with undo_depth, redo_depth and current (the `order` columns of the step in force, null if none is) after each row.

    op is do, undo or redo. A step adds to the undo stack and empties the redo stack; an undo moves the last step to the redo stack, a redo
    moves it back. The log holds accepted requests: one refused for an empty stack is no row (see refused()).

    Depth is a running sum. A step is in force while the depth stays what it made it, or returns to it with no other step in between at that
    depth, so it is the last step of that depth: two windows, no stack. Rows with another op than the three change nothing.
    """
    through = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col(op).isin("do", "redo"), 1).when(F.col(op) == "undo", -1).otherwise(0)
    back = F.when(F.col(op) == "undo", 1).when(F.col(op) == "redo", -1).otherwise(0)
    is_do = F.coalesce(F.col(op) == "do", F.lit(False))
    depths = log.withColumn("undo_depth", F.sum(change).over(through)).withColumn("_since", F.sum(is_do.cast("int")).over(through))
    since = Window.partitionBy(key, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    depths = depths.withColumn("redo_depth", F.sum(back).over(since))
    same = Window.partitionBy(key, "undo_depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.last(F.when(is_do, F.struct(*order)), ignorenulls=True).over(same)
    return depths.withColumn("current", F.when(F.col("undo_depth") > 0, step)).drop("_since")


def refused(log: DataFrame, key: str, order: list[str], op: str) -> DataFrame:
    """Keys whose log can't be one of accepted requests: an undo or redo there finds its stack empty."""
    return undone(log, key, order, op).filter("undo_depth < 0 or redo_depth < 0").select(key).distinct()


def live_steps(log: DataFrame, key: str, order: list[str], op: str) -> DataFrame:
    """key, depth, step (the `order` columns): the stack that a log leaves, from the bottom (depth 1) up."""
    rows = undone(log, key, order, op)
    at = F.struct(*order)
    end = rows.groupBy(key).agg(F.max_by("undo_depth", at).alias("_end"))
    steps = rows.filter(F.col(op) == "do").groupBy(key, F.col("undo_depth").alias("depth")).agg(F.max(at).alias("step"))
    return steps.join(end, key).filter("depth <= _end").select(key, "depth", "step")


#: Words that names of wants may have more or fewer of; fixed values, in the order in which they go.
NOISE = ("placeholder", "element", "text", "block", "box", "group", "the ", "a ", "small ", "tiny ")


def want_name(name: Column) -> Column:
    """A name in small letters without words that only pad it, null for none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    for word in NOISE:
        plain = F.replace(plain, F.lit(word), F.lit(" "))
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def first_without_conflict(rows: DataFrame, order: str, keys: dict[str, Column], always: Column) -> DataFrame:
    """The rows that stay if each, in order, stays unless an earlier one that stayed has one of its keys (a null key is none).

    Rows marked `always` stay and hold no key. `order` must be distinct. The rule looks at what earlier steps left, so a row waits for those before
    it; it is decided by rounds: among the rows not yet decided, one that is the first with each of its keys stays, and
    then all others with a key of it go. Every round decides the first row of each key at least, and ends in a checkpoint; as many rounds are
    needed as rows wait for one another in a chain, few unless keys were made for it. Runs jobs when it is called.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    # Digests, so that a key of any length is compared as 32 characters.
    digest = lambda c: F.when(c.isNotNull(), F.md5(c.cast("string")))
    open_ = settled(rows.filter(~F.coalesce(always, F.lit(False))).select(order, *(digest(c).alias(n) for n, c in zip(names, keys.values(), strict=True))))
    staying = []
    while open_.limit(1).count():
        marked = open_
        for name in names:
            least = open_.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias(f"{name}_least"))
            marked = marked.join(least, name, "left")
        is_first = [F.col(name).isNull() | (F.col(f"{name}_least") == F.col(order)) for name in names]
        now = settled(marked.filter(reduce(and_, is_first, F.lit(True))).select(order, *names))
        staying.append(now.select(order))
        rest = open_.join(now.select(F.col(order).alias("_done")), F.col(order) == F.col("_done"), "left_anti")
        for name in names:
            rest = rest.join(now.filter(F.col(name).isNotNull()).select(F.col(name).alias("_taken")), F.col(name) == F.col("_taken"), "left_anti")
        open_ = settled(rest)
        if len(staying) > 16:  # so that the plan doesn't grow with the rounds
            staying = [settled(reduce(DataFrame.unionByName, staying))]
    kept = rows.filter(F.coalesce(always, F.lit(False)))
    if not staying:
        return kept
    others = rows.filter(~F.coalesce(always, F.lit(False)))
    return kept.unionByName(others.join(reduce(DataFrame.unionByName, staying), order, "left_semi"))
