"""Queries on small pieces: marks of elements, sketches, lists, ids, content, ruled cells, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import clusters, geometry, graphs, grids, reshape, rollups, snapshots, workspace, worksheet
from ..operators.worksheet import Measure
from ..sources.files import table
from .elements import ELEMENTS_SQL, PLACE_SQL, elements
from .registry import query


@query(f"""with e as ({ELEMENTS_SQL}), p as (select *, case when y + h / 2 < 7.5 / 3 then 'top' when y + h / 2 > 7.5 * 2 / 3 then 'bottom' else 'middle' end as row, case when x + w / 2 < 13.333 / 3 then 'left' when x + w / 2 > 13.333 * 2 / 3 then 'right' else 'center' end as col, ('0x' || colour[2:3])::int as r, ('0x' || colour[4:5])::int as g, ('0x' || colour[6:7])::int as b from e)
    select element_id, {PLACE_SQL} as place, case when w * h < 0.05 * 100 then 'small' when w * h < 6 then 'medium' else 'large' end as size, (299 * r + 587 * g + 114 * b) / 1000 > 120 as pale, case when element_id % 3 = 0 then '#' || repeat(colour[2:2], 2) || repeat(colour[3:3], 2) || repeat(colour[4:4], 2) when element_id % 3 = 1 then colour else '#' || colour[2:7] end as hex from p""")
def element_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size band, brightness and the written-out colour of each element."""
    key, colour = F.col("element_id"), F.col("colour")
    area = F.col("w") * F.col("h")
    raw = F.when(key % 3 == 0, F.lower(F.substring(colour, 1, 4))).when(key % 3 == 1, colour).otherwise(F.concat(F.lit("#FF"), F.substring(colour, 2, 6)))
    red, green, blue = values.rgb(colour)
    return elements(spark, sf_dir).select(
        key, values.quadrant(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("place"), values.band(area, [5.0, 6.0], ["small", "medium", "large"]).alias("size"), values.is_pale(colour, 120).alias("pale"), values.hex_colour(raw).alias("hex")
    )


@query("""with d as (select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as idx, o_orderkey, o_totalprice from orders), f as (select * from d where idx < 4)
    select d.o_custkey, d.idx, o_orderpriority as format from d join (select o_custkey, max(idx) as last from f group by 1) l using (o_custkey) join f on f.o_custkey = d.o_custkey and f.idx = least(d.idx, l.last) join orders o on o.o_orderkey = f.o_orderkey""")
def refreshed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New series in the formats of old ones; those beyond take the last one's."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    data = table(spark, sf_dir, "orders").select("o_custkey", nth.cast("int").alias("idx"), F.col("o_orderpriority").alias("format"), F.array("o_totalprice").alias("values"), F.lit("s").alias("name"))
    return reshape.refresh_series(data.filter("idx < 4").select("o_custkey", "idx", "format"), data.drop("format"), ["o_custkey"]).select("o_custkey", "idx", "format")


@query("""select p_partkey, array_to_string(list_concat([p_brand, p_type], list_transform(range(0, 2), lambda x: '')), '|') as padded, lower(regexp_replace(regexp_replace(regexp_replace(p_name || 'Name2Of', '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as snake, case when length(p_type) > 9 then left(p_type, 8) || '…' else p_type end as short, 'Is ' || p_brand || ' ' || '!' as filled from part""")
def written_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit("Name2Of"))
    filled = text.filled_template(F.lit("Is {{brand}} {{nothing}}!"), {"brand": F.col("p_brand")})
    parts = reshape.padded(table(spark, sf_dir, "part").withColumn("cells", F.array("p_brand", "p_type")), "cells", 4)
    return parts.select("p_partkey", F.array_join("cells", "|").alias("padded"), text.snake_case(name).alias("snake"), text.shortened(F.col("p_type"), 9).alias("short"), filled.alias("filled"))


@query("""select count(*) as contents, sum(copies)::bigint as copies, sum(first)::bigint as firsts from (select min(doc_id) as first, count(*) as copies from documents group by text, lang)""")
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.first_of_content(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id")
    return found.agg(F.count("*").alias("contents"), F.sum("copies").alias("copies"), F.sum("first").alias("firsts"))


@query("""with p as (select c_custkey from customer where c_custkey % 4 <> 0), c as (select o_orderkey, o_custkey from orders where o_custkey % 4 <> 0)
    select o_custkey, count(*) as orders, (max(position))::int as last from (select *, row_number() over (partition by o_custkey order by o_orderkey % 7, o_orderkey) as position from c join p on c_custkey = o_custkey) group by 1""")
def lists_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents that go take their children with them; what stays is numbered anew."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parents, children = snapshots.removed_with_children(customers, orders, customers.filter("c_custkey % 4 = 0"), "c_custkey", "o_custkey")
    joined = children.join(parents, F.col("o_custkey") == F.col("c_custkey"))
    placed = snapshots.renumbered(joined, "o_custkey", [F.col("o_orderkey") % 7, F.col("o_orderkey")])
    return placed.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("position").alias("last"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_type when p_partkey % 5 = 0 then p_brand else 'none' end as palette, round(2.0 - 0.5 * (p_size / 4.0), 4)::double as off_x, round(p_size / 4.0, 4)::double as scale_x from part""")
def palettes_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    none = F.array().cast("array<string>")
    palette = graphs.first_palette([F.when(key % 3 == 0, F.array("p_type")).otherwise(none), F.when(key % 5 == 0, F.array("p_brand"))], ["none"])
    offset, scale = graphs.inner_transform(F.lit(2.0), F.lit(0.5), size, F.lit(4.0))
    return table(spark, sf_dir, "part").select(key, F.get(palette, F.lit(0)).alias("palette"), F.round(offset, 4).alias("off_x"), F.round(scale, 4).alias("scale_x"))


@query("""select o_orderstatus, o_orderpriority, sum(case when o_orderkey % 2 = 0 then 1 else 2 end)::bigint as total, count(distinct o_custkey) as people from orders group by 1, 2""")
def sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick look: the first dimensions grouped, the first measures aggregated."""
    dims = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    return worksheet.sketch(table(spark, sf_dir, "orders"), dims, [Measure("total", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2)), Measure("people", F.col("o_custkey"), "countd")])


@query(f"""with e as ({ELEMENTS_SQL}) select kind, round_even(w / 0.5, 0)::int as qw, round_even(h / 0.5, 0)::int as qh, count(*) as repeats, count(distinct page) as pages, min(element_id) as prototype from e where w >= 0.5 group by 1, 2, 3 having count(*) >= 3""")
def repeated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.repeated(elements(spark, sf_dir), "kind", "page", "element_id", least_width=0.5, least=3)


@query("""with n as (select o_custkey, case when o_orderkey % 6 = 0 then 'note' else 'rId' || o_orderkey % 23 end as id, o_orderkey from orders)
    select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by case when starts_with(id, 'rId') then id[4:]::bigint else 0 end, id, o_orderkey))::int as nth from n""")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    named = table(spark, sf_dir, "orders").select("o_custkey", key, F.when(key % 6 == 0, "note").otherwise(F.concat(F.lit("rId"), (key % 23).cast("string"))).alias("id"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(workspace.number_of(F.col("id"), "rId"), "id", "o_orderkey"))
    return named.select("o_custkey", "o_orderkey", nth.alias("nth"))


@query("""with recursive l as (select l_suppkey as page, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey as id, l_linenumber % 2 = 0 as across, (l_partkey % 12)::double as pos, (l_orderkey % 4)::double as low, (6 + l_orderkey % 5)::double as high from lineitem),
    g as (select a.page, a.across, a.pos from l a join l b on a.page = b.page and a.across <> b.across and b.pos between a.low - 1 and a.high + 1 and a.pos between b.low - 1 and b.high + 1 group by a.page, a.id, a.across, a.pos having count(*) >= 2),
    v as (select page, across, pos, row_number() over (partition by page, across order by pos) as i from (select distinct page, across, pos from g)),
    r(page, across, i, first) as (select page, across, i, pos from v where i = 1 union all select v.page, v.across, v.i, case when v.pos - r.first <= 1 then r.first else v.pos end from r join v on v.page = r.page and v.across = r.across and v.i = r.i + 1),
    s as (select page, across, first as pos, row_number() over w - 1 as i, lead(first) over w as next from (select distinct page, across, first from r) window w as (partition by page, across order by first))
    select x.page, y.i::int as row, x.i::int as col, x.pos as x0, y.pos as y0, x.next as x1, y.next as y1 from s x join s y on x.page = y.page and not x.across and y.across where x.next is not null and y.next is not null""")
def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((key * 10 + number) * 100000000 + F.col("l_partkey")).alias("line_id"), (number % 2 == 0).alias("across"), (F.col("l_partkey") % 12).cast("double").alias("at"), (key % 4).cast("double").alias("low"), (6 + key % 5).cast("double").alias("high"))
    return geometry.ruled_cells(lines, ["page"], tolerance=1.0)


@query("""select event_id, user_id, value as "props.n", k as "props.inner.k", md5(event_type)[1:12] as source_id from (select *, (props::json->>'k')::bigint as k from events)""")
def flattened_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as columns by dotted path, and short ids of their sources."""
    inner = F.from_json("props", "k long")
    nested = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct(F.col("value").alias("n"), inner.alias("inner")).alias("props"), F.left(F.md5("event_type"), F.lit(12)).alias("source_id"))
    return nested.select(*workspace.flattened(nested))


@query("""with t as (select o_custkey, list([o_orderkey::varchar, o_orderstatus] order by o_orderkey) as r from orders group by 1)
    select o_custkey, (i - 1)::int as row, case when len(r) > 1 then r[1][j] else 'column_' || (j - 1) end as name, case when len(r) > 1 then r[i + 1][j] else r[i][j] end as value from (select *, unnest(range(1, greatest(len(r), 2))) as i from t), range(1, 3) c(j)""")
def promoted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    tables = rows.select("o_custkey", F.transform("x", lambda r: F.array(r["o_orderkey"].cast("string"), r["o_orderstatus"])).alias("rows"))
    return grids.promoted(tables, "o_custkey", "rows")
