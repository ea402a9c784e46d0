"""Joins that an equality alone doesn't express: as of a time, in a range, nearest, up a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import least_box_at
from .graphs import settled

MOST_PALETTE = 4096


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it (null without one).

    One union and one window: a row of either side is shuffled once and no pairs are made. Of right rows at
    one instant that with the greatest values holds.
    """
    own = [c for c in left.columns if c not in [*keys, at]]
    a = left.select(*keys, at, F.struct(*own).alias("_row"), F.lit(None).alias("_values"), F.lit(1).alias("_side"))
    b = right.select(*keys, at, F.lit(None).alias("_row"), F.struct(*values).alias("_values"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*keys).orderBy(at, "_side", "_values").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_last", F.last("_values", ignorenulls=True).over(order)).filter("_side = 1")
    return found.select(*keys, at, "_row.*", *(F.col(f"_last.{v}").alias(f"last_{v}") for v in values))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, slack: float = 0.0) -> DataFrame:
    """point_id, box_id: the smallest id of the boxes (box_id, x0, y0, x1, y1) that hold a point (point_id, x, y).

    `cell` should be about the smallest boxes' size; larger boxes are entered in coarser grids (see geometry.boxes_around),
    and places and boxes that repeat are looked up once (see geometry.least_box_at).
    """
    first = least_box_at(points, boxes, [], cell, slack)
    return points.join(first, ["x", "y"]).groupBy("point_id").agg(F.min("box_id").alias("box_id"))


def nearest(items: DataFrame, item: str, palette: DataFrame, entry: str, distance: Column) -> DataFrame:
    """Distinct items with the palette entry at the least distance (the first by name of equally near ones).

    The palette is broadcast; one of over MOST_PALETTE entries is refused.
    """
    if palette.limit(MOST_PALETTE + 1).count() > MOST_PALETTE:
        raise ValueError(f"a palette has at most {MOST_PALETTE} entries")
    entries = palette.agg(F.sort_array(F.collect_set(entry)).alias("_entries"))  # one bounded row
    each = items.select(item).distinct().join(F.broadcast(entries)).select(item, F.explode("_entries").alias(entry))
    found = each.select(item, F.struct(distance.alias("distance"), F.col(entry)).alias("_d")).groupBy(item).agg(F.min("_d").alias("_d"))
    return found.select(item, F.col(f"_d.{entry}").alias(entry), F.col("_d.distance").alias("distance"))


def inherited(nodes: DataFrame, node: str, parent: str, value: str, default=None) -> DataFrame:
    """node, value: its own or that of the nearest ancestor with one, else the default.

    Each round looks up the parent's answer and its ancestor twice as far, so that depth d takes log2(d) joins.
    Rounds are checkpointed and end when no row waits for an ancestor any more, or only those do that wait in a
    circle: these get the default. Runs jobs when it is called.
    """
    known = settled(nodes.select(F.col(node), F.when(F.col(value).isNull(), F.col(parent)).alias("_up"), F.col(value)))
    waiting = known.filter("_up is not null").count()
    while waiting:
        up = known.select(F.col(node).alias("_n"), F.col("_up").alias("_up2"), F.col(value).alias("_v"))
        joined = known.join(up, known["_up"] == up["_n"], "left")
        known = settled(joined.select(node, F.when(F.col(value).isNull() & F.col("_v").isNull(), F.col("_up2")).alias("_up"), F.coalesce(value, "_v").alias(value)))
        left = known.filter("_up is not null").count()
        if left == waiting:
            break
        waiting = left
    return known.select(node, F.coalesce(F.col(value), F.lit(default)).alias(value))


def uncovered(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(present, keys, "left_anti")
