"""Queries on formulas and parameters, statements of spend, data of charts and tables, changes of lists, profiles and generated children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas, text
from ..operators import audits, grids, rollups, search, snapshots, spend
from ..sources.files import table
from .elements import ELEMENTS_SQL, elements
from .registry import query
from .usage import CENTS_SQL, cents

DIFFS = ("year", "quarter", "month", "week", "day", "hour")


@query(f"""with o as (select *, o_orderdate + to_months((o_orderkey % 30)::int) + to_days((o_orderkey % 9)::int) + to_hours((o_orderkey % 31)::int) as later from orders)
    select o_orderkey, case when o_totalprice > 150000.0 then 'over' else 'under' end as size, length(o_orderpriority)::int as len, o_custkey::varchar as str, (o_orderdate + to_months((o_orderkey % 30)::int))::timestamp as added, (o_orderdate - to_days(14))::timestamp as earlier,
      {", ".join(f"date_diff('{u}', o_orderdate, later) as {u}s" for u in DIFFS if u != "week")}, (date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', later)) // 7)::bigint as weeks, month(o_orderdate)::int as month, date_trunc('quarter', later)::timestamp as quarter_start from o""")
def formula_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculated fields by the functions of formulas, one with a parameter."""
    given = formulas.Parameters(limit=150000.0)
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    later = formulas.date_add("hour", key % 31, formulas.date_add("day", key % 9, formulas.date_add("month", key % 30, date)))
    return table(spark, sf_dir, "orders").select(
        key,
        formulas.iif(F.col("o_totalprice") > given["limit"], "over", "under").alias("size"),
        formulas.length(F.col("o_orderpriority")).alias("len"),
        formulas.as_text(F.col("o_custkey")).alias("str"),
        formulas.date_add("month", key % 30, date).alias("added"),
        formulas.date_add("week", -2, date).alias("earlier"),
        *(formulas.date_diff(u, date, later).alias(f"{u}s") for u in DIFFS),
        formulas.date_part("month", date).alias("month"),
        formulas.date_trunc("quarter", later).alias("quarter_start"),
    )


@query("""select code, field, case code when 'sum' then case when contains(lower(field), 'sum') then field else 'SUM(' || field || ')' end when 'ctd' then 'COUNTD(' || field || ')' when 'usr' then field else upper(code) || '(' || field || ')' end as shown
    from (select distinct ['sum', 'ctd', 'usr', 'var'][(p_partkey % 4 + 1)::int] as code, case when p_partkey % 8 = 0 then 'Sum of ' || p_brand else p_brand end as field from part)""")
def shown_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that aggregated fields are shown under."""
    key = F.col("p_partkey")
    code = F.get(F.array(*map(F.lit, ("sum", "ctd", "usr", "var"))), (key % 4).cast("int"))
    field = F.when(key % 8 == 0, F.concat(F.lit("Sum of "), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(code.alias("code"), field.alias("field")).distinct().withColumn("shown", formulas.shown_name(F.col("code"), F.col("field")))


READINGS_SQL = f"select user_id, ts, (sum({CENTS_SQL}) over (partition by user_id, date_trunc('month', ts) order by ts range unbounded preceding))::bigint as spent from (select user_id, ts, sum(round(value * 100)) / 100.0 as value from events group by 1, 2)"


@query(f"""with r as ({READINGS_SQL}), t as (select *, spent // 5000 as reached from r), p as (select *, coalesce(max(reached) over (partition by user_id, date_trunc('month', ts) order by ts rows between unbounded preceding and 1 preceding), 0) as before from t),
    a as (select *, reached > before and spent >= 20000 as over from p), k as (select *, over and coalesce(sum(over::int) over (partition by user_id, date_trunc('month', ts) order by ts rows between unbounded preceding and 1 preceding), 0) = 0 as kills from a),
    e as (select *, unnest(range(before + 1, reached + 1)) as i from k where reached > before)
    select user_id, ts::timestamp as ts, (i * 5000.0)::double as boundary, kills and i = reached as kill from e""")
def spend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's spend of the month after each moment, and the boundaries that it alerts."""
    moments = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.sum(cents()).alias("cents"))
    month = Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return spend.alert_ladder(moments.withColumn("spent", F.sum("cents").over(month)), "user_id", "ts", "spent", 5000.0, 20000.0)


CHARGES_SQL = f"select user_id % 50 as account, event_type as service, case when event_id % 9 = 0 then 'Credit' else 'Usage' end as kind, case when event_id % 9 = 0 then -{CENTS_SQL} else {CENTS_SQL} end as amount, ts::date as day from events"


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    credit = F.col("event_id") % 9 == 0
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("account"), F.col("event_type").alias("service"), F.when(credit, "Credit").otherwise("Usage").alias("kind"), F.when(credit, -cents()).otherwise(cents()).alias("amount"), F.to_date("ts").alias("day"))


@query(f"""with c as ({CHARGES_SQL}) select account, coalesce(sum(amount) filter (kind = 'Usage'), 0)::bigint as gross, coalesce(sum(amount) filter (kind = 'Credit'), 0)::bigint as credits, sum(amount)::bigint as net, (max(day) - min(day) + 1)::int as days, round(coalesce(sum(amount) filter (kind = 'Usage'), 0)::bigint / (max(day) - min(day) + 1), 4)::double as daily_burn from c group by 1""")
def spend_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.statement(charges(spark, sf_dir), ["account"], "kind", "amount", "day").withColumn("daily_burn", F.round("daily_burn", 4))


@query(f"""with c as ({CHARGES_SQL}), g as (select account, service, sum(amount)::bigint as gross from c where kind = 'Usage' group by 1, 2), n as (select *, (row_number() over (partition by account order by gross desc, service))::int as nth from g where gross > 1) select * from n where nth <= 3""")
def top_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest services of each account, of those over a cent."""
    return spend.top_services(charges(spark, sf_dir), ["account"], "service", "kind", "amount", least=1, top=3)


@query(f"""with u as (select user_id, count(*) filter (ts >= timestamp '2024-01-30') as a, count(*) as b, coalesce(sum({CENTS_SQL}) filter (ts >= timestamp '2024-01-30'), 0)::bigint as c, sum({CENTS_SQL})::bigint as d from events group by 1),
    l as (select *, case when user_id % 2 = 0 then 1 else 5 end as la, case when user_id % 5 = 0 then 0 else 100 end as lb from u)
    select user_id, greatest(0, la - a)::double as left_day_tokens, greatest(0, lb - b)::double as left_month_tokens, greatest(0, 900 - c)::double as left_day_usd, greatest(0, 60000 - d)::double as left_month_usd,
      round(100.0 * a / greatest(1, la), 1)::double as pct_day_tokens, round(100.0 * b / greatest(1, lb), 1)::double as pct_month_tokens, round(100.0::double * c / 900, 1)::double as pct_day_usd, round(100.0::double * d / 60000, 1)::double as pct_month_usd from l""")
def spend_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each user's limits, and how much of them is used."""
    today = F.col("ts") >= F.lit("2024-01-30").cast("timestamp")
    usage = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(today).alias("day_tokens"), F.count("*").alias("month_tokens"), F.coalesce(F.sum(F.when(today, cents())), F.lit(0)).alias("day_usd"), F.sum(cents()).alias("month_usd"))
    user, none = F.col("user_id"), F.lit(None).cast("double")
    limits = usage.select(user, F.when(user % 2 == 0, 1.0).alias("day_tokens"), F.when(user % 5 == 0, 0.0).alias("month_tokens"), none.alias("day_usd"), none.alias("month_usd"))
    out = spend.utilisation(usage, limits, "user_id", {"day_tokens": 5.0, "month_tokens": 100.0, "day_usd": 900.0, "month_usd": 60000.0})
    return out.drop("day_tokens", "month_tokens", "day_usd", "month_usd")


@query("""with l as (select o_custkey as page, o_orderkey as shape, l_returnflag as f, l_linestatus as s, l_quantity as q, row_number() over (partition by o_orderkey order by l_linenumber, l_returnflag, l_linestatus, l_quantity) - 1 as i, count(*) over (partition by o_orderkey) as n from orders join lineitem on l_orderkey = o_orderkey)
    select page, shape, i::int as idx, case when shape % 4 = 0 then 'Series_0' else 'quantity' end as name, f as category, q::varchar as value from l where shape % 2 = 0 union all
    select page, shape, (case when shape % 3 = 0 then i + 1 else i end)::int, case when shape % 3 = 0 then 'column_0' else 'flag' end, null, f from l where shape % 2 = 1 union all
    select page, shape, (case when shape % 3 = 0 then i + 1 else i end)::int, case when shape % 3 = 0 then 'column_1' else 'status' end, null, s from l where shape % 2 = 1 union all
    select page, shape, 0, unnest(['column_0', 'column_1']), null, unnest(['flag', 'status']) from l where shape % 2 = 1 and shape % 3 = 0 and i = 0""")
def extracted_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as charts (of quantities) and tables (of flags) on their customers' pages: the data of all of them."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem")
    each = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("shape")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"))).alias("x"))
    is_chart = F.col("shape") % 2 == 0
    series = F.array(F.struct(F.when(F.col("shape") % 4 != 0, "quantity").alias("name"), F.col("x.l_quantity").alias("values")))
    body = F.concat(F.array(F.array(F.lit("flag"), F.lit("status"))), F.transform("x", lambda r: F.array(r["l_returnflag"], r["l_linestatus"])))
    parts = each.select(F.lit(1).alias("deck"), "page", "shape", F.when(is_chart, "chart").otherwise("table").alias("kind"), F.col("x.l_returnflag").alias("categories"), series.alias("series"), body.alias("rows"), (F.col("shape") % 3 != 0).alias("has_header"))
    return grids.extracted(parts, ["deck"]).drop("deck")


@query("""with c as (select o_custkey, list(o_orderpriority order by o_orderkey)[1:3] as cats, list(o_totalprice order by o_orderkey) as a, coalesce(list(o_totalprice order by o_orderkey) filter (o_orderstatus = 'F'), []) as b from orders group by 1),
    p as (select *, unnest(range(0, greatest(len(cats), len(a), len(b)))) as idx from c)
    select o_custkey, idx::int as idx, coalesce(cats[idx + 1], 'Cat ' || (idx + 1)) as category, s as series, case when s = 'all' then a[idx + 1] else b[idx + 1] end as value from p, (values ('all'), ('Series 2')) v(s)""")
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged series and too few categories, made even."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"))).alias("x"))
    finished = F.transform(F.filter("x", lambda r: r["o_orderstatus"] == "F"), lambda r: r["o_totalprice"])
    series = F.array(F.struct(F.lit("all").alias("name"), F.col("x.o_totalprice").alias("values")), F.struct(F.lit("").alias("name"), finished.alias("values")))
    return grids.category_rows(rows.select("o_custkey", F.slice("x.o_orderpriority", 1, 3).alias("categories"), series.alias("series")), "o_custkey")


@query("""with c as (select c_mktsegment as chart, row_number() over (partition by c_mktsegment order by r_regionkey, n_nationkey, c_custkey) - 1 as idx, c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select chart, idx::int as idx, r_name || '/' || n_name || '/' || c_name as path from c""")
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves below nations and regions: each level's labels stand where they begin."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("r_regionkey", "n_nationkey", "c_custkey")) - 1
    leaves = joined.select(F.col("c_mktsegment").alias("chart"), nth.alias("idx"), "c_name", "n_name", "r_name")
    label = lambda level, name: leaves.groupBy("chart", F.col(name).alias("label")).agg(F.min("idx").alias("idx")).select("chart", F.lit(level).alias("level"), "idx", "label")
    labels = leaves.select("chart", F.lit(0).alias("level"), "idx", F.col("c_name").alias("label")).unionByName(label(1, "n_name")).unionByName(label(2, "r_name"))
    return grids.flattened_categories(labels, "chart").select("chart", "idx", F.array_join("path", "/").alias("path"))


@query("""select s_suppkey, r::int as row, c::int as col, null as text from (select *, unnest(range(0, (s_suppkey % 4)::int)) as r from supplier), range(3) t(c) where c < s_suppkey % 3 union all
    select -s_suppkey, 0, 0, s_name from supplier union all select -s_suppkey, 0, 1, '' from supplier""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of empty tables of given sizes, and of tables given by their rows."""
    key = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    empty = grids.empty_grid(supplier, "s_suppkey", key % 4, key % 3).withColumn("text", F.lit(None).cast("string"))
    filled = grids.cells(supplier.withColumn("cells", F.array(F.col("s_name"), F.lit(None).cast("string"))), "s_suppkey", "cells")
    return empty.unionByName(filled.select((-F.col("row")).alias("s_suppkey"), F.lit(0).alias("row"), "col", "text"))


@query("""with c as (select l_orderkey as t, l_linenumber - 1 as r, k as col, case when (l_partkey + k) % 3 = 0 then 'x' when (l_partkey + k) % 3 = 1 then '' end as text, case when k = 0 then '#FFF' end as fill from lineitem, range(3) s(k)),
    m as (select o_orderkey as t, 0 as r0, (o_orderkey % 3)::int as r1, 0 as c0, (o_orderkey % 2)::int as c1 from orders)
    select c.t as l_orderkey, (max(r) + 1)::int as n_rows, (max(col) + 1)::int as n_cols, count(*) as n_cells, count(*) filter (text <> '') as with_text, count(*) filter (fill <> '') as filled, 0::bigint as bordered, count(*) filter (r between r0 and r1 and col between c0 and c1 and (r1 > r0 or c1 > c0)) as merged from c join m on m.t = c.t group by 1""")
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables with three columns, some of whose cells are merged."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (line - 1).alias("row"), part, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"))
    turn = (part + F.col("col")) % 3
    cells = cells.select("l_orderkey", "row", "col", F.when(turn == 0, "x").when(turn == 1, "").alias("text"), F.when(F.col("col") == 0, "#FFF").alias("fill"), F.lit(None).cast("string").alias("border"))
    key = F.col("o_orderkey")
    merges = table(spark, sf_dir, "orders").select(key.alias("l_orderkey"), F.lit(0).alias("top"), (key % 3).cast("int").alias("bottom"), F.lit(0).alias("left"), (key % 2).cast("int").alias("right"))
    return audits.merged_facts(cells, merges, "l_orderkey")


@query("""with c as (select event_id, event_id % 2000 as id, ['status', 'error', 'elapsed', 'owner'][(event_id % 4 + 1)::int] as field, case when event_id % 11 = 0 then null when event_id % 4 = 2 then user_id::varchar else event_type end as value from events),
    l as (select id, field, arg_max({'v': value}, event_id)['v'] as value from c group by 1, 2), w as (select p_partkey from part)
    select p_partkey, case when s.id is null then p_brand else s.value end as status, case when e.id is null then p_type else e.value end as error, case when t.id is null then p_size else t.value::int end as elapsed, p_name as owner
    from part left join l s on s.id = p_partkey and s.field = 'status' left join l e on e.id = p_partkey and e.field = 'error' left join l t on t.id = p_partkey and t.field = 'elapsed'""")
def updated_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after patches of single fields; a field that may not be changed stays."""
    key = F.col("event_id")
    field = F.get(F.array(*map(F.lit, ("status", "error", "elapsed", "owner"))), (key % 4).cast("int"))
    value = F.when(key % 11 == 0, None).when(key % 4 == 2, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    changes = table(spark, sf_dir, "events").select((key % 2000).alias("p_partkey"), key.alias("at"), field.alias("field"), value.alias("value"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("status"), F.col("p_type").alias("error"), F.col("p_size").alias("elapsed"), F.col("p_name").alias("owner"))
    return snapshots.updated(rows, changes, "p_partkey", "at", ["status", "error", "elapsed"])


@query("""with o as (select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey))::double as place from orders),
    a as (select o_custkey, o_orderkey, case when o_orderkey % 7 = 2 then place - 2.5 else place end as place from o where o_orderkey % 5 <> 1 union all select o_custkey, -o_orderkey, place + 0.25 from o where o_orderkey % 6 = 3)
    select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by place, o_orderkey))::int as position from a""")
def reordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders after moves, deletes and duplicates; later operations on one row override earlier ones."""
    key, place = F.col("o_orderkey"), F.col("place")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_custkey", key, nth.alias("place"))
    op = lambda when, at, name, to, new: rows.filter(when).select("o_custkey", "o_orderkey", F.lit(at).alias("at"), F.lit(name).alias("op"), to.alias("place"), new.cast("long").alias("new_key"))
    none = F.lit(None)
    made = [op(key % 7 == 2, 2, "move", place - 2.5, none), op(key % 7 == 2, 1, "move", place + 9, none), op(key % 5 == 1, 3, "delete", none.cast("double"), none), op(key % 6 == 3, 1, "duplicate", place + 0.25, -key)]
    operations = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return snapshots.reordered(rows, operations, "o_custkey", "o_orderkey", "place").select("o_custkey", "o_orderkey", "position")


@query(f"""with e as ({ELEMENTS_SQL}), f as (select page, 'font' as f, font as v, min(element_id) as first, count(*) as n from e group by all union all select page, 'colour', colour, min(element_id), count(*) from e group by all union all select page, 'kind', kind, min(element_id), count(*) from e group by all),
    r as (select *, row_number() over (partition by page, f order by n desc, first) as i from f), g as (select page, count(*) as members, avg((w > 2)::int) > 0.5 as wide, avg((z > 12)::int) > 0.5 as high from e group by 1)
    select g.page, wide, high, members, max(v) filter (f = 'font' and i = 1) as font, max(v) filter (f = 'kind' and i = 1) as kind, string_agg(v, ',' order by i) filter (f = 'colour' and i <= 4) as colours from g join r on r.page = g.page group by all""")
def style_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page: its main font and kind, its four main colours, and whether most elements are wide or lie high."""
    out = rollups.style_profile(elements(spark, sf_dir), "page", {"font": "font", "kind": "kind"}, {"colours": ("colour", 4)}, {"wide": F.col("w") > 2, "high": F.col("z") > 12}, "element_id")
    return out.withColumn("colours", F.array_join("colours", ","))


@query("""with k as (select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey))::int as nth, o_orderkey from orders), l as (select o_custkey, nth, 'old ' || o_orderkey as body from k where o_orderkey % 4 = 0),
    n as (select c_custkey as o_custkey, nth::int as nth, c_mktsegment || ' ' || nth || ' of ' || (c_custkey % 5) as body from (select *, unnest(range(1, (c_custkey % 5 + 1)::int)) as nth from customer))
    select o_custkey, nth, body, true as locked from l union all select n.o_custkey, n.nth, n.body, false from n left join l on l.o_custkey = n.o_custkey and l.nth = n.nth where l.nth is null""")
def generated_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each customer made anew by a function; locked ones stay."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    old = table(spark, sf_dir, "orders").select("o_custkey", nth.alias("nth"), F.concat(F.lit("old "), F.col("o_orderkey").cast("string")).alias("body"), (F.col("o_orderkey") % 4 == 0).alias("locked"))
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", (F.col("c_custkey") % 5).alias("wanted"))
    return audits.generated(groups, old, "o_custkey", ["c_mktsegment", "wanted"], lambda group, name, wanted: [f"{name} {i} of {wanted}" for i in range(1, wanted + 1)])


@query("""select o_orderkey, 1 as score from orders order by o_orderdate desc, o_orderkey limit 8""")
def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty search shows what changed last."""
    orders = table(spark, sf_dir, "orders")
    return search.recent_or_scored(orders, " ", text.search_score(F.col("o_orderpriority"), ""), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "score")


@query(f"""with e as ({ELEMENTS_SQL}) select element_id, '{{"x":' || round(x / 3, 3)::double || ',"w":' || round(w, 3)::double || case when z % 3 <> 0 then ',"z":' || (z::double) else '' end || ',"kind":"' || kind || '"' || case when element_id % 4 <> 0 then ',"text":"' || left(label || label || label || label, 60) || '"' else '' end || '}}' as print from e""")
def element_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each element counts as a change."""
    key, z, label = F.col("element_id"), F.col("z"), F.col("label")
    printed = snapshots.element_print({"x": F.col("x") / 3, "w": F.col("w"), "z": F.when(z % 3 != 0, z)}, {"kind": F.col("kind"), "text": F.when(key % 4 != 0, F.repeat(label, 4)).otherwise("")}, most=60)
    return elements(spark, sf_dir).select(key, printed.alias("print"))
