"""Cells of tables and series of charts: forms of data, refreshes that keep formats, merges, chunks of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(rows: DataFrame, row: str, values: str) -> DataFrame:
    """row, col, text: a cell for each entry of an array column; nulls are empty texts."""
    return rows.select(F.col(row).alias("row"), F.posexplode(values).alias("col", "text")).select("row", "col", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def empty_grid(df: DataFrame, key: str, n_rows: Column, n_cols: Column) -> DataFrame:
    """key, row, col of all cells of tables of these sizes."""
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(key, F.explode(upto(n_rows)).alias("row"), n_cols.alias("_n")).select(key, "row", F.explode(upto(F.col("_n"))).alias("col"))


def promoted(df: DataFrame, key: str, rows: str, has_header: bool = True) -> DataFrame:
    """key, row, name, value of tables whose rows are arrays: the first row names the columns if there is a further one."""
    promote = F.lit(has_header) & (F.size(rows) > 1)
    names = F.when(promote, F.get(F.col(rows), F.lit(0)))
    body = df.select(key, names.alias("_names"), F.posexplode(F.when(promote, F.slice(rows, F.lit(2), F.size(rows))).otherwise(F.col(rows))).alias("row", "_row"))
    each = body.select(key, "row", "_names", F.posexplode("_row").alias("_col", "value"))
    return each.select(key, "row", F.coalesce(F.get("_names", "_col"), F.concat(F.lit("column_"), "_col")).alias("name"), "value")


def refreshed(data: DataFrame, formats: DataFrame, key: str) -> DataFrame:
    """New cells data(key, row, col, text) with formats(key, row, col, format) of the old table.

    A row beyond the old ones takes the format of the last old row; a column beyond them has none; old rows beyond
    the new are gone. The last row of each table is found once; cells are joined by place.
    """
    last = formats.groupBy(key).agg(F.max("row").alias("_last"))
    at = data.join(last, key, "left").withColumn("_row", F.least("row", "_last"))
    old = formats.select(key, F.col("row").alias("_row"), "col", "format")
    return at.join(old, [key, "_row", "col"], "left").select(key, "row", "col", "text", "format")


def merged(cells_: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Cells(key, row, col) with is_origin, spanned, row_span and col_span under merges(key, top, left, bottom, right).

    Merges that share a cell are an error, which a job looks for when this is called.
    """
    opened = merges.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right")))
    if opened.groupBy(key, "row", "col").count().filter("count > 1").limit(1).count():
        raise ValueError("merges overlap")
    here = (F.col("row") == F.col("top")) & (F.col("col") == F.col("left"))
    span = lambda high, low: F.when(here, F.col(high) - F.col(low) + 1).otherwise(1)
    marked = opened.select(key, "row", "col", here.alias("is_origin"), (~here).alias("spanned"), span("bottom", "top").alias("row_span"), span("right", "left").alias("col_span"))
    joined = cells_.join(marked, [key, "row", "col"], "left")
    return joined.select(key, "row", "col", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("is_origin", False), ("spanned", False), ("row_span", 1), ("col_span", 1))))


def banded(rows: DataFrame, key: str, order: list, header: bool = True) -> DataFrame:
    """Rows with their number from 1 and band: every other row after the header, which has none."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    after = F.col("nth") - (1 if header else 0)
    return rows.withColumn("nth", nth).withColumn("band", F.when(after > 0, after % 2 == 1))


def chart_frame(series: DataFrame, key: str) -> DataFrame:
    """key, idx, category, series, value of series(key, at, name, categories, values): a series without a name is Series_{at}."""
    named = series.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Series_"), F.col("at"))))
    zipped = named.select(key, "at", "name", F.posexplode(F.arrays_zip(F.col("categories").alias("category"), F.col("values").alias("value"))).alias("idx", "_z"))
    return zipped.select(key, "idx", "_z.category", F.col("name").alias("series"), F.col("_z.value").cast("double").alias("value"))


SHAPE = "categories array<string>, series array<struct<name string, values array<double>>>, columns array<string>, rows array<array<string>>, data array<array<string>>, text string"


def script_outputs(outputs: DataFrame, key: str, kind: str, payload: str) -> DataFrame:
    """key, applied, reason, categories, series, cells, text: what a script's JSON output changes in its element.

    Charts take categories with series, or columns with rows (the first column is the category, a null value 0);
    tables take data, or columns with rows (the header is row 0); texts take a text. All else is refused with a reason.
    """
    x = F.from_json(F.col(payload), SHAPE)
    rows = outputs.select(key, F.col(kind).alias("_kind"), F.col(payload).isNull().alias("_none"), x.alias("_x"))
    col = lambda c: F.col(f"_x.{c}")
    framed = col("columns").isNotNull() & col("rows").isNotNull() & (F.size(col("columns")) > 0) & (F.size(col("rows")) > 0)
    values = lambda i: F.transform(col("rows"), lambda r: F.coalesce(F.get(r, i + 1).try_cast("double"), F.lit(0.0)))
    from_rows = F.transform(F.slice(col("columns"), F.lit(2), F.size(col("columns"))), lambda c, i: F.struct(c.alias("name"), values(i).alias("values")))
    is_chart, is_table, is_text = (F.col("_kind") == k for k in ("chart", "table", "text"))
    series = F.when(is_chart, F.coalesce(col("series"), F.when(framed, from_rows)))
    categories = F.when(is_chart, F.when(col("series").isNull() & framed, F.transform(col("rows"), lambda r: F.get(r, F.lit(0)))).otherwise(col("categories")))
    grid = F.when(is_table, F.coalesce(col("data"), F.when(framed, F.concat(F.array(col("columns")), col("rows")))))
    text = F.when(is_text | (F.col("_kind") == "shape"), col("text"))
    ok = series.isNotNull() | categories.isNotNull() | (F.size(grid) > 0) | text.isNotNull()
    known = F.col("_kind").isin("chart", "table", "text", "shape")
    reason = F.when(F.col("_none"), "no output").when(~known, "no way to apply").when(~F.coalesce(ok, F.lit(False)), "no known shape")
    return rows.select(key, reason.isNull().alias("applied"), reason.alias("reason"), categories.alias("categories"), series.alias("series"), grid.alias("cells"), text.alias("text"))


def sheet_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """id, kind (csv_header, csv_rows), line_start, line_end, text: a sheet's header, then its rows in groups, each under the header.

    Blank groups and empty or null texts have no chunk. Lines end at line feeds.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\n$", ""), "\n", -1)
    rows = docs.filter(F.length(text_col) > 0).select(id_col, lines.alias("_lines"))
    header, n = F.get("_lines", F.lit(0)), F.size("_lines")
    starts = F.when(n > 1, F.sequence(F.lit(2), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    body = lambda i: F.array_join(F.slice("_lines", i, size), "\n")
    made = F.transform(starts, lambda i: F.struct(F.lit("csv_rows").alias("kind"), i.alias("line_start"), F.least(i + size - 1, n).alias("line_end"), body(i).alias("text")))
    shown = F.transform(F.filter(made, lambda c: F.trim(F.replace(c["text"], F.lit("\n"), F.lit(""))) != ""), lambda c: F.struct(c["kind"].alias("kind"), c["line_start"].alias("line_start"), c["line_end"].alias("line_end"), F.concat(header, F.lit("\n"), c["text"]).alias("text")))
    first = F.array(F.struct(F.lit("csv_header").alias("kind"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), header.alias("text")))
    return rows.select(id_col, F.explode(F.concat(first, shown)).alias("_c")).select(id_col, "_c.*")


def extracted(elements: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """key, page, shape, idx, name, category, value: the data of all charts and tables among elements, under their page and shape.

    elements(key, page, shape, kind, categories, series(name, values), rows, has_header): a chart gives a row for each point, named by its series
    (Series_{i} for one without a name); a table a row for each cell below its header, named by its column, with the text as value. Others give none.
    """
    at = [*key, "page", "shape"]
    charts = elements.filter(F.col(kind) == "chart").select(*at, "categories", F.posexplode("series").alias("_i", "_s"))
    name = F.coalesce(F.nullif("_s.name", F.lit("")), F.concat(F.lit("Series_"), F.col("_i")))
    points = charts.select(*at, name.alias("name"), "categories", F.posexplode("_s.values").alias("idx", "_v")).select(*at, "idx", "name", F.get("categories", F.col("idx")).alias("category"), F.col("_v").cast("string").alias("value"))
    tables = elements.filter(F.col(kind) == "table").select(F.struct(*at).alias("_at"), "has_header", "rows")
    parts = [promoted(tables.filter(flag), "_at", "rows", has) for flag, has in (("has_header", True), ("not coalesce(has_header, false)", False))]
    cells_ = parts[0].unionByName(parts[1]).select(*(F.col(f"_at.{c}").alias(c) for c in at), F.col("row").alias("idx"), "name", F.lit(None).cast("string").alias("category"), "value")
    return points.unionByName(cells_)


def category_rows(charts: DataFrame, key: str) -> DataFrame:
    """key, idx, category, series, value of charts(key, categories, series(name, values)), each as long as its longest series or its categories.

    A category that is missing is "Cat n", a series without a name "Series n", a value beyond its series null.
    """
    longest = F.greatest(F.size("categories"), F.array_max(F.concat(F.array(F.lit(0)), F.transform("series", lambda s: F.size(s["values"])))))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    each = charts.select(key, "categories", F.posexplode("series").alias("_i", "_s"), places.alias("_at")).select(key, "categories", "_i", "_s", F.explode("_at").alias("idx"))
    category = F.coalesce(F.get("categories", F.col("idx")), F.concat(F.lit("Cat "), (F.col("idx") + 1).cast("string")))
    series = F.coalesce(F.nullif("_s.name", F.lit("")), F.concat(F.lit("Series "), (F.col("_i") + 1).cast("string")))
    return each.select(key, "idx", category.alias("category"), series.alias("series"), F.get("_s.values", F.col("idx")).alias("value"))


def flattened_categories(labels: DataFrame, key: str) -> DataFrame:
    """key, idx, path: the full path of each leaf of labels(key, level, idx, label), the outermost label first.

    Level 0 holds the leaves; on higher levels a label holds from its idx on, up to the next one's. One window a chart: each level's last label so far.
    A level without a label up to there gives an empty one.
    """
    depth = labels.groupBy(key).agg(F.max("level").alias("_depth"))
    joined = labels.join(depth, key)
    # Every label stands once for each level, so that a leaf sees the last one of each; at one place it comes behind those of higher levels.
    so_far = Window.partitionBy(key, "_n").orderBy("idx", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    told = F.last(F.when(F.col("level") == F.col("_n"), F.col("label")), ignorenulls=True).over(so_far)
    each = joined.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("_depth")))).withColumn("_told", told).filter("level = 0")
    return each.groupBy(key, "idx").agg(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("_n", F.coalesce("_told", F.lit("")).alias("x"))))), lambda s: s["x"]).alias("path"))
