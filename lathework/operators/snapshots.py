"""Differences of two snapshots, and writes expressed as new versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change (added, removed, modified), fields: the names of those that differ. One full outer join."""
    side = lambda df, name: df.select(*keys, F.struct(*fields).alias(name))
    both = side(before, "_old").join(side(after, "_new"), keys, "full_outer")
    differs = [F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields]
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size("_fields") > 0, "modified")
    names = F.array_compact(F.array(*differs))
    out = both.withColumn("_fields", names).select(*keys, kind.alias("change"), F.when(kind == "modified", F.array_join("_fields", ",")).otherwise("").alias("fields"))
    return out.filter("change is not null")


def summaries(changes: DataFrame, by: str, change: str, what: str) -> DataFrame:
    """by, summary: how many of each change there are, in words; "No changes." where none is."""
    counted = changes.groupBy(by).agg(*(F.count_if(F.col(change) == kind).alias(kind) for kind in ("added", "modified", "removed")))
    said = lambda kind: F.when(F.col(kind) > 0, F.concat(F.col(kind).cast("string"), F.lit(f" {what}"), F.when(F.col(kind) > 1, "s").otherwise(""), F.lit(f" {kind}")))
    words = F.concat_ws(", ", *(said(kind) for kind in ("added", "modified", "removed")))
    return counted.select(by, F.when(words == "", "No changes.").otherwise(F.concat(words, F.lit("."))).alias("summary"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows replace those of their keys; a null in a new row keeps the old value."""
    rest = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in rest))
    return old.join(renamed, keys, "full_outer").select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in rest))


def latest(versions: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return versions.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def removed_with_children(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents named in gone(key)."""
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, parent_key), parent_key, "left_anti")


def renumbered(rows: DataFrame, group: str, order: list, name: str = "position") -> DataFrame:
    """Positions from 1 anew after inserts, moves and deletes."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


#: What a job may become.
NEXT_STATES = {"queued": ["running", "failed"], "running": ["completed", "failed"], "completed": [], "failed": []}


def bad_transitions(history: DataFrame, key: str, status: str, order: list, allowed: dict[str, list[str]] | None = None, first: str | None = "queued") -> DataFrame:
    """Rows of a history whose status may not follow the one before (null: it is a start)."""
    allowed = allowed or NEXT_STATES
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    fine = F.lit(True) if first is None else F.col(status) == first
    ok = F.when(F.col("previous").isNull(), fine)
    for state, following in allowed.items():
        ok = ok.when(F.col("previous") == state, F.col(status).isin(*following) if following else F.lit(False))
    return history.withColumn("previous", before).filter(~F.coalesce(ok.otherwise(False), F.lit(False)))


def updated(rows: DataFrame, changes: DataFrame, key: str, at: str, allowed: list[str]) -> DataFrame:
    """Rows after changes(key, at, field, value as text): the last change of each allowed field holds, a null value too; other fields and unknown keys change nothing.

    A value that doesn't fit its column's type is an error.
    """
    last = changes.filter(F.col("field").isin(*allowed)).groupBy(key).pivot("field", allowed).agg(F.max_by(F.struct("value"), at))
    joined = rows.join(last.select(key, *(F.col(f).alias(f"_new_{f}") for f in allowed)), key, "left")
    set_to = lambda f: F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.value").cast(rows.schema[f].dataType)).otherwise(F.col(f))
    return joined.select(*(set_to(c).alias(c) if c in allowed else F.col(c) for c in rows.columns))


def reordered(rows: DataFrame, operations: DataFrame, group: str, key: str, place: str) -> DataFrame:
    """Rows(group, key, place, ...) after operations(group, key, at, op, place, new_key), with position from 1 in their group.

    Places are numbers between which there is always another, so an insert or a move names one and touches a single row: of each row the last move
    or delete (by at) holds. A duplicate adds a copy of the row as new_key at its place, to which later operations may refer; copies of copies are
    not made here. An operation on a key that isn't there does nothing. Equal places stand in order of key.
    """
    copies = operations.filter("op = 'duplicate'").select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col("new_key").alias("_new"), F.col(place).alias("_place"))
    added = rows.join(copies, (F.col(group) == F.col("_g")) & (F.col(key) == F.col("_k")))
    added = added.select(*(F.col("_new").alias(c) if c == key else F.col("_place").alias(c) if c == place else F.col(c) for c in rows.columns))
    last = operations.filter("op in ('move', 'delete')").groupBy(group, key).agg(F.max_by(F.struct("op", F.col(place).alias("to")), "at").alias("_op"))
    after = rows.unionByName(added).join(last, [group, key], "left").filter("_op is null or _op.op = 'move'").withColumn(place, F.coalesce("_op.to", place)).drop("_op")
    return renumbered(after.select(*rows.columns), group, [F.col(place), F.col(key)])


def element_print(numbers: dict[str, Column], texts: dict[str, Column], most: int = 120) -> Column:
    """What of an element counts as a change, as JSON: numbers to 3 places, texts to `most` characters; what is null or empty is left out."""
    kept = [F.round(c.cast("double"), 3).alias(n) for n, c in numbers.items()] + [F.nullif(F.left(c, F.lit(most)), F.lit("")).alias(n) for n, c in texts.items()]
    return F.to_json(F.struct(*kept))
