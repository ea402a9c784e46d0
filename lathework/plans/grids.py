"""Queries on cells, series, refreshes and scripts' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout, phrases
from ..operators import grids, worksheet
from ..operators.worksheet import Measure
from ..sources.files import table
from .registry import query


@query("""with d as (select l_suppkey % 20 as sheet, (l_orderkey % 9)::int as row, (l_linenumber - 1)::int as col, min(l_partkey)::varchar as text from lineitem group by 1, 2, 3),
    f as (select l_suppkey % 20 as sheet, (l_orderkey % 5)::int as row, (l_linenumber - 1)::int as col, min(l_returnflag || l_linestatus) as format from lineitem where l_linenumber <= 4 group by 1, 2, 3),
    m as (select sheet, max(row) as last from f group by 1)
    select d.sheet, d.row, d.col, text, format from d left join m using (sheet) left join f on f.sheet = d.sheet and f.row = least(d.row, last) and f.col = d.col""")
def refreshed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("sheet"), "l_orderkey", (F.col("l_linenumber") - 1).cast("int").alias("col"), "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("look"))
    place = lambda n: (F.col("l_orderkey") % n).cast("int").alias("row")
    data = lines.groupBy("sheet", place(9), "col").agg(F.min("l_partkey").cast("string").alias("text"))
    formats = lines.filter("col < 4").groupBy("sheet", place(5), "col").agg(F.min("look").alias("format"))
    return grids.refreshed(data, formats, "sheet")


@query("""with c as (select l_suppkey % 20 as sheet, (l_orderkey % 9)::int as row, (l_linenumber - 1)::int as col from lineitem group by 1, 2, 3), m as (select distinct sheet, 2 + (sheet % 3)::int as t, 1 as l, 4 + (sheet % 3)::int as b, 3 as r from c)
    select c.sheet, row, col, coalesce(row = t and col = l, false) as is_origin, coalesce(not (row = t and col = l), false) as spanned, case when row = t and col = l then b - t + 1 else 1 end as row_span, case when row = t and col = l then r - l + 1 else 1 end as col_span
    from c left join m on c.sheet = m.sheet and row between t and b and col between l and r""")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("sheet"), (F.col("l_orderkey") % 9).cast("int").alias("row"), (F.col("l_linenumber") - 1).cast("int").alias("col")).distinct()
    shift = (F.col("sheet") % 3).cast("int")
    merges = cells.select("sheet").distinct().select("sheet", (shift + 2).alias("top"), F.lit(1).alias("left"), (shift + 4).alias("bottom"), F.lit(3).alias("right"))
    return grids.merged(cells, merges, "sheet")


@query("""select o_custkey, o_orderkey, (row_number() over w)::int as nth, case when row_number() over w > 1 then row_number() over w % 2 = 0 end as band from orders window w as (partition by o_custkey order by o_orderkey)""")
def banded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.banded(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")])


@query("""with l as (select doc_id, case when ends_with(text, chr(10)) then text[1:-2] else text end as t from documents where length(text) > 0), s as (select doc_id, string_split(t, chr(10)) as lines from l),
    c as (select doc_id, 'csv_header' as kind, 1 as line_start, 1 as line_end, lines[1] as text from s union all
      select doc_id, 'csv_rows', i::int, least(i + 4, len(lines))::int, lines[1] || chr(10) || array_to_string(lines[i:i + 4], chr(10)) from (select doc_id, lines, unnest(range(2, len(lines) + 1, 5)) as i from s) where trim(array_to_string(lines[i:i + 4], ''), ' ') <> '')
    select doc_id, kind, line_start, line_end, md5(text) as text_md5 from c""")
def sheet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.sheet_chunks(table(spark, sf_dir, "documents"), size=5).select("doc_id", "kind", "line_start", "line_end", F.md5("text").alias("text_md5"))


@query("""with s as (select o_custkey, o_orderstatus as at, case when o_orderstatus = 'P' then 'Series_P' else o_orderstatus end as name, list(o_orderpriority order by o_orderkey) as c, list(o_totalprice order by o_orderkey) as v from orders group by 1, 2)
    select o_custkey, (i - 1)::int as idx, c[i] as category, name as series, v[i] as value from (select *, unnest(range(1, len(c) + 1)) as i from s)""")
def chart_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("at")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_totalprice"))).alias("x"))
    series = rows.select("o_custkey", "at", F.when(F.col("at") != "P", F.col("at")).alias("name"), F.col("x.o_orderpriority").alias("categories"), F.col("x.o_totalprice").alias("values"))
    return grids.chart_frame(series, "o_custkey")


@query("""with p as (select c_custkey, c_custkey % 5 as k, c_name, round(c_acctbal, 2) as v from customer)
    select c_custkey, k in (0, 1, 2, 3) as applied, case when k = 4 then 'no known shape' end as reason, case when k in (0, 1) then 2 else 0 end as n_categories, case k when 0 then v when 1 then 0.0 end as first_value, case k when 2 then 3 when 3 then 0 else 0 end as n_cells, case when k = 3 then c_name end as text from p""")
def script_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of all shapes: a chart, a chart as a frame with a null, a table, a text, and one of no known shape."""
    key, value = F.col("c_custkey") % 5, F.round("c_acctbal", 2)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    payload = (
        F.when(key == 0, F.concat(F.lit('{"categories": ["a", "b"], "series": [{"name": "s", "values": ['), value.cast("string"), F.lit(", 1]}]}")))
        .when(key == 1, F.lit('{"columns": ["c", "s"], "rows": [["a", null], ["b", "2"]]}'))
        .when(key == 2, F.lit('{"data": [["a", "b"], ["c", null], []]}'))
        .when(key == 3, F.concat(F.lit('{"text": '), quoted(F.col("c_name")), F.lit("}")))
        .otherwise(F.lit('{"other": 1}'))
    )
    kind = F.when(key < 2, "chart").when(key == 2, "table").otherwise("text")
    out = grids.script_outputs(table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), payload.alias("payload")), "c_custkey", "kind", "payload")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select("c_custkey", "applied", "reason", n("categories").alias("n_categories"), F.get(F.get("series", F.lit(0))["values"], F.lit(0)).alias("first_value"), n("cells").alias("n_cells"), "text")


FORMATS = ("0%", "$0", "0.00", "0.0", "general")


@query("""select o_orderkey, case o_orderkey % 5 when 0 then printf('%.0f', v * 100) || '%' when 1 then '$' || printf('%.0f', v) when 2 then printf('%.2f', v) when 3 then printf('%.1f', v) else v::bigint::varchar end as shown,
      epoch_ms(((epoch(o_orderdate)::bigint + case o_orderkey % 4 when 0 then 3600 when 1 then 86400 when 2 then 604800 end) * 1000)::bigint) as next_run from (select *, (o_orderkey % 1000)::double as v from orders)""")
def labels_and_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    form = F.get(F.array(*map(F.lit, FORMATS)), (key % 5).cast("int"))
    value = F.when(key % 5 == 4, (key % 1000).cast("string")).otherwise((key % 1000).cast("double").cast("string"))
    number = F.when(key % 5 == 4, value).otherwise(layout.shown_number((key % 1000).cast("double"), form))
    schedule = F.get(F.array(*map(F.lit, ("hourly", "daily", "weekly", "on_demand"))), (key % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("shown"), layout.next_run(F.col("o_orderdate"), schedule).cast("timestamp_ntz").alias("next_run"))


@query("""with f as (select n_regionkey, n_nationkey, sum(c_acctbal) as total from customer join nation on c_nationkey = n_nationkey group by 1, 2),
    s as (select n_regionkey, c_mktsegment, count(*) as n, sum(c_acctbal) as b from customer join nation on c_nationkey = n_nationkey group by 1, 2)
    select s.n_regionkey, c_mktsegment, n, r as region_n, round(i, 2) as mean_nation_total from s join (select n_regionkey, sum(n)::bigint as r from s group by 1) using (n_regionkey) join (select n_regionkey, avg(total) as i from f group by 1) using (n_regionkey)""")
def detail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level that leaves the segment out, and one that takes the nation in."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = worksheet.with_excluded(rows, ["n_regionkey", "c_mktsegment"], ["c_mktsegment"], Measure("n", F.lit(1), "cnt"), Measure("region_n", F.lit(1), "cnt"))
    finer = worksheet.with_included(rows, ["n_regionkey"], ["n_nationkey"], Measure("total", F.col("c_acctbal")), Measure("mean_nation_total", F.col("total"), "avg"))
    return out.join(finer, "n_regionkey").withColumn("mean_nation_total", F.round("mean_nation_total", 2))


@query("""select o_orderpriority, count(*) as n from orders where o_totalprice between 1000 and 250000 and (o_orderpriority = '1-URGENT' or o_orderpriority in ('2-HIGH', '3-MEDIUM', '5-LOW')) and o_orderpriority <> '5-LOW' group by 1""")
def filtered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"except": [{"union": [{"member": "1-URGENT"}, {"union": [{"member": m} for m in ("2-HIGH", "3-MEDIUM", "5-LOW")]}]}, {"member": "5-LOW"}]}
    kept = table(spark, sf_dir, "orders").filter(worksheet.members(F.col("o_orderpriority"), rule) & worksheet.members(F.col("o_totalprice"), {"range": (1000, 250000)}))
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""with c as (select * from customer where c_mktsegment = 'BUILDING'), b as (select c_nationkey, count(*) as n from c group by 1 order by n desc, 1 limit 5)
    select c_nationkey, count(*) as n, round(min(c_acctbal), 2) as least from c where c_nationkey in (select c_nationkey from b) group by 1""")
def top_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = worksheet.top_in_context(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey"), Measure("n", F.lit(1), "cnt"), 5)
    return kept.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.min("c_acctbal"), 2).alias("least"))


@query("""with t as (select o_orderpriority as p, year(o_orderdate)::int as y, count(*) as n from orders group by 1, 2)
    select p, y, n, lead(n, 2) over o as looked_up, min(n) over w as window_min, (sum(n) over w)::bigint as window_sum, min(n) over (o rows between 1 preceding and 1 following) as near_min, round(percent_rank() over (partition by p order by n), 6) as percentile from t window w as (partition by p), o as (partition by p order by y)""")
def looked_up_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return worksheet.looked_up(shown, "n", [F.col("y")], ["p"], away=2).withColumn("percentile", F.round("percentile", 6))


@query("""select doc_id, regexp_replace(coalesce(text, ''), '(?i)the ', 'THE ', 'g') = coalesce(text, '') as same, len(regexp_extract_all(coalesce(text, ''), '(?i)the '))::int as changes, md5(regexp_replace(coalesce(text, ''), '(?i)the ', 'A$1 ', 'g')) as changed_md5 from documents""")
def find_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, n = phrases.replaced(F.col("text"), "the ", "THE ", case=False)
    put, _ = phrases.replaced(F.col("text"), "the ", "A$1 ", case=False)
    return table(spark, sf_dir, "documents").select("doc_id", (upper == F.coalesce("text", F.lit(""))).alias("same"), n.alias("changes"), F.md5(put).alias("changed_md5"))


def _want_sql(column: str) -> str:
    out = f"lower({column})"
    for word in phrases.NOISE:
        out = f"replace({out}, '{word}', ' ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


@query(f"""select p_partkey, 'py' as x, case p_partkey % 6 when 0 then 'python' when 1 then 'csv' when 2 then 'json' when 3 then 'text' when 4 then 'text' else 'other' end as kind, regexp_replace(f, '[^A-Za-z0-9._\\-]', '_', 'g') as safe, {_want_sql("p_name")} as want
    from (select *, replace(p_name, ' ', '/') || '.' || ['py', 'CSV', 'json', 'txt', 'md', 'bin'][(p_partkey % 6 + 1)::int] as f from part)""")
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, ("py", "CSV", "json", "txt", "md", "bin"))), (F.col("p_partkey") % 6).cast("int"))
    name = F.concat(F.translate("p_name", " ", "/"), F.lit("."), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", F.lit("py").alias("x"), phrases.file_kind(name).alias("kind"), phrases.safe_file_name(name).alias("safe"), phrases.want_name(F.col("p_name")).alias("want"))


@query("""select event_id, case when event_id % 4 = 0 then '{"k": ' || (props::json->>'k') || '}' when event_id % 4 = 1 then props when event_id % 4 = 2 then props end as found from events""")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, props = F.col("event_id") % 4, F.col("props")
    wrapped = F.when(key == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(key == 1, F.concat(F.lit("Here it is: "), props, F.lit(" - done"))).when(key == 2, props).otherwise(F.lit("no {json here"))
    return table(spark, sf_dir, "events").select("event_id", phrases.json_within(wrapped).alias("found"))
