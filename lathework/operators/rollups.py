"""Roll-ups of styles and structure: modes, majorities, ranked roles, fingerprints, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_by(df: DataFrame, keys: list[str], value: str, position: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which comes first. Nulls don't count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(name))


def majority(flag: Column) -> Column:
    """Whether more than half of a group's known flags are true."""
    return F.avg(flag.cast("int")) > 0.5


def ranked_roles(counts: DataFrame, value: str, n: str, roles: list[tuple[int, str]], otherwise: str, top: int) -> DataFrame:
    """The most frequent values with a role by rank: roles are (last rank, name) in order. Top-k before the ranking."""
    best = counts.orderBy(F.desc(n), value).limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc(n), F.col(value)))  # at most `top` rows
    out = best.withColumn("rank", rank)
    role = F.lit(otherwise)
    for last, name in reversed(roles):
        role = F.when(F.col("rank") <= last, name).otherwise(role)
    return out.withColumn("role", role)


def structure_groups(parts: DataFrame, owner: str, kind: str) -> DataFrame:
    """Owners with the same kinds of parts and as many of them: signature, n_parts, members, prototype (smallest owner).

    Kinds are counted per owner first, so that an owner of very many parts is a few rows, and groups keep
    only counts and the smallest member.
    """
    per_kind = parts.groupBy(owner, kind).agg(F.count("*").alias("_n"))
    per_owner = per_kind.groupBy(owner).agg(F.array_join(F.sort_array(F.collect_set(kind)), "|").alias("signature"), F.sum("_n").alias("n_parts"))
    return per_owner.groupBy("signature", "n_parts").agg(F.count("*").alias("members"), F.min(owner).alias("prototype"))


def first_of_content(df: DataFrame, content: list[str], order: str) -> DataFrame:
    """One row per distinct content, the first in order: first, content_hash, copies."""
    hashed = F.substring(F.sha2(F.to_json(F.struct(*content)), 256), 1, 16)
    return df.groupBy(hashed.alias("content_hash")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def coverage(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """by, field, filled, missing: how many rows have each field. One pass; empty text counts as missing."""
    has = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    counted = df.groupBy(by).agg(F.count("*").alias("_n"), *(F.count_if(has(f)).alias(f) for f in fields))
    return counted.unpivot([by, "_n"], fields, "field", "filled").select(by, "field", "filled", (F.col("_n") - F.col("filled")).alias("missing"))


def varying(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """by, field, n_values of the fields that take several values in a group. Long values are counted by 128-bit digests."""
    counted = df.groupBy(by).agg(*(F.count_distinct(F.md5(F.col(f).cast("string"))).alias(f) for f in fields))
    return counted.unpivot(by, fields, "field", "n_values").filter("n_values >= 2")


def first_values(df: DataFrame, by: str, field: str, order: str, least: int = 2) -> DataFrame:
    """by, values: the distinct values of a field in the order in which they first appear, for groups that have at least `least` of them.

    A group's values are one array in the result, so this is for fields of few values; repeats are gone before they are listed.
    """
    firsts = df.filter(F.col(field).isNotNull()).groupBy(by, field).agg(F.min(order).alias("_at"))
    lists = firsts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_at", field))).alias("_all")).filter(F.size("_all") >= least)
    return lists.select(by, F.transform("_all", lambda x: x[field]).alias("values"))


def longest(df: DataFrame, by: str, items: str, order: str, name: str = "longest") -> DataFrame:
    """The longest list of each group, the first of equally long ones."""
    return df.groupBy(by).agg(F.max_by(items, F.struct(F.size(items), -F.col(order))).alias(name))


def style_profile(df: DataFrame, by: str, modes: dict[str, str], lists: dict[str, tuple[str, int]], flags: dict[str, Column], position: str) -> DataFrame:
    """One row per group: the most frequent value of each of modes, the most frequent values of each of lists (column, how many), whether most of each of flags hold.

    Of equally frequent values that which comes first by position leads; nulls don't count; a flag that is never known is null. All features are
    counted in one shuffle, as rows of (group, feature, value), before any is ranked.
    """
    columns = {**modes, **{name: c for name, (c, _) in lists.items()}}
    shape = [F.struct(F.lit(name).alias("feature"), F.col(c).cast("string").alias("value")) for name, c in columns.items()]
    each = df.select(by, F.col(position).alias("_at"), F.explode(F.array(*shape)).alias("_f")).select(by, "_at", "_f.*").filter("value is not null")
    counted = each.groupBy(by, "feature", "value").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    nth = F.row_number().over(Window.partitionBy(by, "feature").orderBy(F.desc("_n"), "_first"))
    most = {**dict.fromkeys(modes, 1), **{name: k for name, (_, k) in lists.items()}}
    wanted = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))
    top = counted.withColumn("_nth", nth).filter(F.col("_nth") <= F.element_at(wanted, F.col("feature")))
    listed = top.groupBy(by).pivot("feature", list(columns)).agg(F.sort_array(F.collect_list(F.struct("_nth", "value"))))
    values = [F.get(F.col(f"{name}.value"), F.lit(0)).alias(name) for name in modes] + [F.col(f"{name}.value").alias(name) for name in lists]
    held = df.groupBy(by).agg(*(majority(c).alias(name) for name, c in flags.items()), F.count("*").alias("members"))
    return held.join(listed.select(by, *values), by, "left")


def percent_where(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """by, count, and per cent of the rows for which each flag holds, to one place; a null flag doesn't hold."""
    return df.groupBy(*by).agg(F.count("*").alias("count"), *(F.round(100 * F.count_if(c) / F.count("*"), 1).alias(name) for name, c in flags.items()))
