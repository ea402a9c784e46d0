"""Interaction of filters over all orders in which they can be applied, by paths through the lattice of their subsets.

A state is the set of filters applied so far, whatever their order; applying one more is an edge to the next
state. What an edge removes does not depend on how its state was reached, so all k! orders share k * 2**(k - 1)
edges. Orders that reach a state are counted forward, those that leave it backward; an edge lies on the product of both
counts, which weights its removals for the Shapley value, and the steps of each order are read from the same edges.

Documents enter as the number that fail each combination of filters, so the lattice is as small for any table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More filters would have too many orders to list.
MOST_FILTERS = 7


def path_counts(k: int) -> dict[tuple[int, int], int]:
    """(state, filter) -> the number of orders that pass through that edge. States are sets of bits."""
    states, full = range(1 << k), (1 << k) - 1
    edges = [(s, f) for s in states for f in range(k) if not s >> f & 1]
    forward, backward = [int(s == 0) for s in states], [int(s == full) for s in states]
    for s, f in edges:
        forward[s | 1 << f] += forward[s]
    for s, f in reversed(edges):
        backward[s] += backward[s | 1 << f]
    return {(s, f): forward[s] * backward[s | 1 << f] for s, f in edges}


def order_steps(names: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def filter_interaction(failed: DataFrame, names: Sequence[str], part_col: str, marks: Mapping[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step of it.

    failed: a row per document with part_col (text), and by each of names a boolean column, true if it fails that filter; marks
    names boolean columns by the results' columns that count them. The result: part, filter_order (the names joined), step (from 1),
    and counts within the part: kept (after this step), removed (here), redundant (failing its filter, removed
    earlier), unique_fails (failing its filter alone), one by each key of marks (marked and removed here), shapley (what its filter
    removes, summed over all orders).

    Nulls count as false, a null part as the empty string; repeated rows count each; other columns are not read. A part stands in the
    result if it has a row in failed, with zeros where nothing goes: an empty table gives an empty result.
    """
    k, marks = len(names), dict(marks or {})
    if not 1 <= k <= MOST_FILTERS or len(set(names)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different names are wanted")
    spark = failed.sparkSession
    mask = sum((F.when(F.col(name), F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(names)), F.lit(0))
    rows = failed.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.alias("mask"), *(F.col(c).alias(f"mark_{i}") for i, c in enumerate(marks.values())))
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.count_if(F.col(f"mark_{i}")).alias(f"mark_{i}") for i in range(len(marks))))

    # Every combination of failures at every edge: 32 * 80 rows a part with five filters, however many documents there are.
    numbered = counted.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit((k << k) - 1))))
    numbered = numbered.withColumns({"state": F.expr(f"cast(edge div {k} as int)"), "filter": F.expr(f"cast(edge % {k} as int)")}).withColumn("bit", F.expr("shiftleft(1, filter)"))
    at_edge = numbered.filter(F.col("state").bitwiseAND(F.col("bit")) == 0)
    reached, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda which, of="n": F.sum(F.when(which, F.col(of)).otherwise(F.lit(0)))
    measures = {
        "kept": total(reached & ~fails),
        "removed": total(reached & fails),
        "redundant": total(~reached & fails),
        "unique_fails": total(F.col("mask") == F.col("bit")),
        **{name: total(reached & fails, f"mark_{i}") for i, name in enumerate(marks)},
    }
    edges = at_edge.groupBy("part", "state", "filter").agg(*(c.alias(name) for name, c in measures.items()))
    paths = spark.createDataFrame([(s, f, n) for (s, f), n in path_counts(k).items()], "state int, filter int, paths long")
    of_filter = Window.partitionBy("part", "filter")
    weighed = edges.join(paths, ["state", "filter"]).withColumn("shapley", F.sum(F.col("paths") * F.col("removed")).over(of_filter))
    steps = spark.createDataFrame(order_steps(names), "filter_order string, step int, state int, filter int")
    return weighed.join(steps, ["state", "filter"]).select("part", "filter_order", "step", *measures, "shapley")


def repeating(docs: DataFrame, key_col: str, id_col: str, as_col: str) -> DataFrame:
    """docs with as_col: whether a row with a smaller id has the same key. A null id is neither smaller nor larger than any."""
    least = docs.groupBy(F.col(key_col).alias("_key")).agg(F.min(id_col).alias("_least"), F.max(id_col).alias("_most")).filter("_least < _most").select("_key", "_least")
    return docs.join(least, F.col(key_col) == F.col("_key"), "left").withColumn(as_col, F.coalesce(F.col(id_col) > F.col("_least"), F.lit(False))).drop("_key", "_least")


WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters A to D of the query on a text that is not null: too few words, too many repeated, too many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def text_filter_interaction(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters of the query over all orders, by language: A to D of text_failures(), and E: a copy of a text with a smaller id.

    labels(doc_id, quality, toxic): a document is marked if any of its rows there has a 1; marked removals are good_lost and toxic_lost. A null
    text is an empty one: copies of each other, failing A alone besides. A null id has no labels and fails E never. Repeated rows
    count each, and share an id, so none is the other's earlier copy. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(part_col).cast("string").alias("part"), text.alias("_text"))
    failed = rows.select("_id", "part", F.sha2("_text", 256).alias("_print"), *(c.alias(name) for name, c in text_failures(F.col("_text")).items()))
    failed = repeating(failed, "_print", "_id", "E")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    failed = failed.join(marked, F.col("_id") == F.col("_labelled"), "left")
    return filter_interaction(failed, "ABCDE", "part", {"good_lost": "good", "toxic_lost": "toxic"})
