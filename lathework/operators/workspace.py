"""Lists of a workspace: visibility, paging, top-k with pins, due work, names and numbers still free, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIER


def visible(rows: DataFrame, org, scopes: list[str], owner) -> DataFrame:
    """Rows(org, scope, owner, builtin) of an organisation in one of the scopes or one's own, and all that are built in."""
    return rows.filter(((F.col("org") == org) & (F.col("scope").isin(*scopes) | (F.col("owner") == owner))) | F.col("builtin"))


def page(rows: DataFrame, order: list, size: int, start: int = 0) -> DataFrame:
    """A page in a total order; Spark keeps only start + size rows of each partition."""
    return rows.orderBy(*order).offset(start).limit(size)


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs(enabled, next_run) to start: enabled, with a time that has come."""
    return jobs.filter(F.col("enabled") & F.col("next_run").isNotNull() & (F.col("next_run") <= now))


def first_of(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keys, values: of each key's rows the first in order, without sorting them."""
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return found.select(*keys, *(F.col(f"_first.{v}").alias(v) for v in values))


def changed_where(rows: DataFrame, changes: DataFrame, key: str, status: str, must_be: str) -> DataFrame:
    """Rows after changes(key, status), which only rows with the status `must_be` take."""
    new = changes.select(key, F.col(status).alias("_new"))
    to = F.when((F.col(status) == must_be) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(status))
    return rows.join(new, key, "left").withColumn(status, to).drop("_new")


def without(rows: DataFrame, gone: DataFrame, key: str, kept: Column) -> DataFrame:
    """Rows without those whose key is gone, save protected ones."""
    return rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").filter(F.col("_gone").isNull() | kept).drop("_gone")


def pinned_top(rows: DataFrame, score: str, pinned: Column, fallback: Column, ties: list[str], top: int) -> DataFrame:
    """Pinned rows first, then scored ones best first, then fallbacks without a score, `top` in all; `why` says which."""
    why = F.when(pinned, "pinned").when(F.col(score) > 0, "scored").when(fallback, "fallback")
    rank = F.when(pinned, 0).when(F.col(score) > 0, 1).otherwise(2)
    return rows.withColumn("why", why).filter("why is not null").orderBy(rank, F.when(rank == 1, -F.col(score)).otherwise(0), *ties).limit(top)


def overlapping(left: DataFrame, left_id: str, left_names: str, right: DataFrame, right_id: str, right_names: str) -> DataFrame:
    """left_id, right_id, shared: of which right rows a left row has names, and how many; most first within a left row by `nth`."""
    a = left.select(left_id, F.explode(F.array_distinct(left_names)).alias("_name"))
    b = right.select(right_id, F.explode(F.array_distinct(right_names)).alias("_name"))
    shared = a.join(b, "_name").groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
    return shared.withColumn("nth", F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc("shared"), right_id)))


def zipped(left: DataFrame, right: DataFrame, key: str, left_order: list, right_order: list) -> DataFrame:
    """The n-th row of left with the n-th row of right of each key, as long as both have one; `nth` counts from 1."""
    place = lambda df, order: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return place(left, left_order).join(place(right, right_order), [key, "nth"])


def free_number(used: DataFrame, group: str, name: str, prefix: str) -> DataFrame:
    """group, next: the largest number from count + 1 down that no name prefix{n} has taken."""
    numbers = used.select(group, F.regexp_extract(name, f"^{prefix}([1-9][0-9]*)$", 1).try_cast("long").alias("_n"))
    counted = used.groupBy(group).agg(F.count("*").alias("_count"))
    taken = numbers.join(counted, group).filter(F.col("_n") <= F.col("_count") + 1).select(group, "_n").distinct()
    # Numbers from the top down without a gap: at the k-th of them stands count + 2 - k.
    down = taken.join(counted, group).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"))))
    run = down.filter(F.col("_n") == F.col("_count") + 2 - F.col("_k")).groupBy(group).agg(F.count("*").alias("_run"))
    return counted.join(run, group, "left").select(group, (F.col("_count") + 1 - F.coalesce("_run", F.lit(0))).alias("next"))


def number_of(name: Column, prefix: str) -> Column:
    """The number in a name, 0 without one, so that rId10 comes after rId2."""
    return F.coalesce(F.regexp_extract(name, f"^{prefix}([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))


def filled_inputs(templates: DataFrame, schema: DataFrame, inputs: DataFrame, template: str) -> DataFrame:
    """template, missing, inputs: each template's inputs (a map), defaults filled in, and the required ones still missing.

    schema(template, name, required, default), inputs(template, name, value). Nulls without a default are dropped.
    """
    joined = schema.join(inputs, [template, "name"], "left").withColumn("_value", F.coalesce("value", "default"))
    lacking = F.col("required") & F.col("_value").isNull()
    entries = F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("name", F.col("_value").alias("value"))))
    given = joined.groupBy(template).agg(F.sort_array(F.collect_list(F.when(lacking, F.col("name")))).alias("missing"), F.map_from_entries(F.sort_array(entries)).alias("inputs"))
    none = F.array().cast("array<string>")
    return templates.join(given, template, "left").select(*templates.columns, F.coalesce("missing", none).alias("missing"), "inputs")


def materialised(text: Column, inputs: Column) -> Column:
    """A template's text with each {{name}} replaced by its input, by nothing without one."""
    holes = F.split(text, r"\{\{\s*\w+\s*\}\}", -1)
    names = F.regexp_extract_all(text, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))
    return F.array_join(F.zip_with(holes, names, lambda gap, name: F.concat(gap, F.coalesce(F.element_at(inputs, name), F.lit("")))), "")


def template_search(templates: DataFrame, request: str, id_col: str, text_col: str, top: int = 5) -> DataFrame:
    """The templates that share most words of three letters or more with a request: id, shared; equal ones by id."""
    import re

    wanted = sorted({w.lower() for w in re.findall(IDENTIFIER, request) if len(w) >= 3})
    words = F.split(F.lower(F.array_join(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), " ")), " ")
    shared = F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)).cast("array<string>")))
    return templates.select(id_col, shared.alias("shared")).filter("shared > 0").orderBy(F.desc("shared"), id_col).limit(top)


def once_each(wants: DataFrame, order: str, name: Column, ids: Column, always: Column) -> DataFrame:
    """Wants without those that repeat an earlier one's name or set of ids; rows that are always kept count for neither.

    A repeated name or set goes if its first holder comes before it. (A holder that itself goes still counts: the
    rule looks at rows, not at what an earlier step left of them, so that it needs no order of work.)
    """
    marked = wants.withColumns({"_name": F.nullif(name, F.lit("")), "_ids": F.when(F.size(ids) > 0, F.array_join(F.sort_array(F.array_distinct(ids)), ",")), "_always": always})
    others = marked.filter(~F.col("_always"))
    first = lambda c: others.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias(f"{c}_first"))
    joined = marked.join(first("_name"), "_name", "left").join(first("_ids"), "_ids", "left")
    repeats = lambda c: F.coalesce(F.col(f"{c}_first") < F.col(order), F.lit(False))
    return joined.filter(F.col("_always") | ~(repeats("_name") | repeats("_ids"))).select(*wants.columns)


def gaps(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """id, gap: a row for each rule that a row breaks; one pass."""
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(id_col, F.explode(broken).alias("gap"))


def over_time(changes: DataFrame, key: str, at: str, change: str, ties: list[str]) -> DataFrame:
    """Changes with the running sum of their key, as of each: how many connections are open."""
    order = Window.partitionBy(key).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("open", F.sum(change).over(order))


def violators(events: DataFrame, key: str, at: str, seconds: int = 30, least: int = 5) -> DataFrame:
    """Events(key, at in seconds) of a key that were at least the `least`-th within the trailing seconds.

    Events are counted by key and time; a count is needed in its own span of that many seconds and in the next one. So a window holds two spans'
    distinct times, however long the table and however few the keys. Events without a time count one another.
    """
    counted = events.groupBy(F.col(key).alias("_key"), F.col(at).alias("_at")).agg(F.count("*").alias("_n"))
    span = F.floor(F.col("_at") / max(seconds, 1))
    both = counted.withColumn("_span", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(span, span + 1))))
    trailing = Window.partitionBy("_key", "_span").orderBy("_at").rangeBetween(-seconds, 0)
    own = F.col("_at").isNull() | (F.col("_span") == span)
    seen = both.withColumn("violations", F.sum("_n").over(trailing)).filter(own).filter(F.col("violations") >= least)
    joined = events.join(seen, F.col(key).eqNullSafe(F.col("_key")) & F.col(at).eqNullSafe(F.col("_at")))
    return joined.select(*(events[c] for c in events.columns), "violations")


def kept_versions(versions: DataFrame, key: str, version: str, most: int) -> DataFrame:
    """The latest versions of each key; older ones drop out of the ring."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return versions.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def flattened(df: DataFrame) -> list[Column]:
    """The leaves of all struct columns as columns named by dotted paths."""
    out = []

    def walk(field, column: Column, name: str) -> None:
        if hasattr(field.dataType, "fields"):
            for inner in field.dataType.fields:
                walk(inner, column[inner.name], f"{name}.{inner.name}")
        else:
            out.append(column.alias(name))

    for field in df.schema.fields:
        walk(field, F.col(field.name), field.name)
    return out


def where_given(rows: DataFrame, equals: dict[str, object], since: tuple[str, object] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """Rows that agree with all wishes that are given; None and empty texts are none. since and until are (column, bound), the latter excluded."""
    out = rows
    for column, value in equals.items():
        if value is not None and value != "":
            out = out.filter(F.col(column) == value)
    if since and since[1] is not None:
        out = out.filter(F.col(since[0]) >= since[1])
    if until and until[1] is not None:
        out = out.filter(F.col(until[0]) < until[1])
    return out


def dispatched(jobs: DataFrame, now: Column, after: Column) -> DataFrame:
    """Jobs(enabled, next_run, status, ...) as they are once the due ones are started: status dispatched, next_run as `after` says, so that none starts twice."""
    is_due = F.coalesce(F.col("enabled") & (F.col("next_run") <= now), F.lit(False))
    marked = jobs.withColumn("_due", is_due)
    return marked.withColumns({"status": F.when(F.col("_due"), "dispatched").otherwise(F.col("status")), "next_run": F.when(F.col("_due"), after).otherwise(F.col("next_run"))}).drop("_due")


#: Ends of paths whose requests are not recorded; fixed values.
UNRECORDED = (
    "/element-png", "/bridge.png", "/original.png", "/rebuilt.png", "/diagnostics", "/render-status", "/export", "/export-pdf", "/export-png-zip", "/export-html", "/export-script", "/export-markdown",
    "/notes-export", "/notes-html-export", "/notes-pages-pdf", "/notes-summary", "/snapshots", "/undo-state", "/save-to-cloud", "/templates", "/template-variables", "/style", "/text", "/elements",
)


def recorded_requests(requests: DataFrame) -> DataFrame:
    """requests(method, path, status int, handled boolean, ...) that an audit log records, with result (executed or failed) and error.

    Reads are never recorded, nor what its handler has recorded itself; paths with an exempt end only if the server failed. Works on a stream, too; follow it
    with dropDuplicatesWithinWatermark on the request's id where the source may send one twice.
    """
    exempt = F.rlike("path", F.lit("(?:" + "|".join(x.replace(".", r"\.") for x in UNRECORDED) + ")$"))
    kept = requests.filter((F.upper("method") != "GET") & ~F.coalesce("handled", F.lit(False))).filter((F.col("status") >= 500) | ~exempt)
    failed = F.col("status") >= 400
    return kept.withColumns({"result": F.when(failed, "failed").otherwise("executed"), "error": F.when(failed, F.concat(F.lit("HTTP "), F.col("status").cast("string")))})
