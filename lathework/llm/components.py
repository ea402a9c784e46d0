"""Connected components of a link table, by passing on the least label and jumping to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, written


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (id, component): the least id that links lead to. Ids without links are not in it.

    Every round is a written table. A hub with very many links is no bottleneck: its label reaches its
    neighbours through a join that Spark can split, and labels are reduced before they are shuffled.
    """
    edges = links.select("a", "b").filter("a <> b")
    edges = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        # What each vertex hears from its neighbours, and what those labels are labelled themselves.
        heard = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = written(lower.join(roots, "component", "left").select("id", "was", F.least("component", "root").alias("component")), "labels")
        changed = after.filter("component <> was").limit(1).count()
        remove(labels)
        labels = after.select("id", "component")
        if not changed:
            remove(edges)
            return labels
