"""Reachability, composed transforms, and values that come from layers."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the session's folder; a temporary one is set only where none is named and one machine runs all.

    Spark deletes a checkpoint once nothing refers to it if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lathework-"))
    return df.checkpoint()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth: what edges(source, target) lead to from roots(node), by the fewest edges; roots have depth 0.

    Each round joins only the nodes found in the last one; cycles end, as known nodes are not visited again.
    Targets without edges of their own are leaves. Runs jobs when it is called, one a level.
    """
    frontier = settled(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    levels = [frontier]
    while frontier.limit(1).count():
        after = edges.join(frontier, edges["source"] == frontier["node"]).select(F.col("target").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        known = reduce(DataFrame.unionByName, levels).select("node")
        frontier = settled(after.join(known, "node", "left_anti"))
        levels.append(frontier)
        if len(levels) > 8:  # so that neither the plan nor the number of tables grows with the depth
            levels = [settled(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that links(source, target) connect each node with. Nodes without links are not in it.

    Each round a node takes the least label of its neighbours and then that label's own label; rounds are
    checkpointed, and end when nothing changes. Runs jobs when it is called.
    """
    edges = links.select("source", "target").filter("source <> target")
    edges = settled(edges.union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    labels = settled(edges.groupBy(F.col("source").alias("node")).agg(F.least(F.min("target"), F.first("source")).alias("component")))
    while True:
        heard = edges.join(labels, edges["target"] == labels["node"]).groupBy("source").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("source")).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = settled(lower.join(roots, "component", "left").select("node", "was", F.least("component", "root").alias("component")))
        labels = after.drop("was")
        if not after.filter("component <> was").limit(1).count():
            return labels


def composed(groups: DataFrame) -> DataFrame:
    """id, off_x, off_y, scale_x, scale_y: from a group's inner coordinates to those of the page.

    groups: id, parent, and the same four against the parent's coordinates. Transforms compose in any
    grouping, so each round doubles how far up a row reaches: depth d takes log2(d) joins, each checkpointed.
    Rounds end when every row has reached a group without a known parent. Groups in a cycle, or below one, have
    no page to reach and raise a ValueError. Runs jobs when it is called.
    """
    axes = ("off_x", "off_y", "scale_x", "scale_y")
    known = groups.select("id", F.col("parent").alias("up"), *(F.col(c).cast("double").alias(c) for c in axes))
    known = known.join(groups.select(F.col("id").alias("up"), F.lit(True).alias("_is")), "up", "left")
    known = settled(known.select("id", F.when(F.col("_is"), F.col("up")).alias("up"), *axes))
    waiting = known.filter("up is not null").count()
    while waiting:
        outer = known.select(F.col("id").alias("up"), F.col("up").alias("_up"), *(F.col(c).alias(f"_{c}") for c in axes))
        joined = known.join(outer, "up", "left")
        offset = lambda a: F.coalesce(F.col(f"_off_{a}") + F.col(f"_scale_{a}") * F.col(f"off_{a}"), F.col(f"off_{a}")).alias(f"off_{a}")
        scale = lambda a: (F.coalesce(f"_scale_{a}", F.lit(1.0)) * F.col(f"scale_{a}")).alias(f"scale_{a}")
        known = settled(joined.select("id", F.col("_up").alias("up"), offset("x"), offset("y"), scale("x"), scale("y")))
        left = known.filter("up is not null").count()
        # Each round, rows whose reach ends among those that have arrived arrive, too; if none does, a cycle holds them all.
        if left == waiting:
            raise ValueError(f"{left} groups are in or below a cycle")
        waiting = left
    return known.drop("up")


def inner_transform(off: Column, inner_off: Column, extent: Column, inner_extent: Column) -> tuple[Column, Column]:
    """Offset and scale of a group's axis from where it and its inner coordinates begin and how far they reach."""
    scale = F.coalesce(extent / F.coalesce(F.nullif(inner_extent, F.lit(0)), F.lit(1)), F.lit(1.0))
    return off - inner_off * scale, scale


def cascaded(layers: dict[str, Column], default=None) -> Column:
    """(value, origin): the value of the first layer that has one and the layer's name, else the default."""
    origin = F.coalesce(*(F.when(value.isNotNull(), F.lit(name)) for name, value in layers.items()), F.lit("default"))
    return F.struct(F.coalesce(*layers.values(), F.lit(default)).alias("value"), origin.alias("origin"))


def overlaid(layers: list[Column]) -> Column:
    """The value of the last layer that has one."""
    return F.coalesce(*reversed(layers))


def first_palette(candidates: list[Column], default: list[str]) -> Column:
    """The first array of colours with any entry, else the default."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in candidates), F.array(*map(F.lit, default)))
