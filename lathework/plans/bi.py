"""Worksheet, reshape and table-calculation queries over the sales tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import reshape, worksheet
from ..operators.worksheet import Measure
from ..sources.files import table
from .registry import query


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers, nations, regions = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.join(nations, customers.c_nationkey == nations.n_nationkey).join(regions, nations.n_regionkey == regions.r_regionkey)


SALES = """lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
NET_SQL = "l_extendedprice * (1 - l_discount)"


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(f"""select n_name as category, round(sum({NET_SQL}), 2) as revenue, count(distinct o_orderkey) as orders, round(avg(l_discount), 4) as discount
    from {SALES} where n_name is not null group by 1 order by 2 desc nulls last, 1 limit 10""")
def ranked_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [Measure("revenue", net()), Measure("orders", F.col("o_orderkey"), "countd"), Measure("discount", F.col("l_discount"), "avg")]
    out = worksheet.worksheet(sales(spark, sf_dir), F.col("n_name"), shown)
    return out.withColumns({"revenue": F.round("revenue", 2), "discount": F.round("discount", 4)})


@query("""select date_trunc('month', o_orderdate)::timestamp as category, round(sum(o_totalprice), 2) as total, count(o_orderkey) as n
    from orders where o_orderdate is not null group by 1 order by 1 limit 36""")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [Measure("total", F.col("o_totalprice")), Measure("n", F.col("o_orderkey"), "cnt")]
    out = worksheet.worksheet(table(spark, sf_dir, "orders"), values.date_level(F.col("o_orderdate"), "mnth"), shown, ranked=False)
    return out.withColumn("total", F.round("total", 2))


@query("""select l_shipmode as category, median(l_quantity) as med, round(var_samp(l_quantity), 4) as var, round(stddev_samp(l_quantity), 4) as stdev
    from (select l_returnflag || l_linestatus as l_shipmode, l_quantity from lineitem) group by 1 order by 2 desc, 1""")
def spread_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    shown = [Measure("med", q, "med"), Measure("var", q, "var"), Measure("stdev", q, "stdev")]
    out = worksheet.worksheet(table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), shown)
    return out.withColumns({c: F.round(c, 4) for c in ("var", "stdev")})


@query(f"""select r_name, n_name, round(sum({NET_SQL}), 2) as revenue, grouping(r_name, n_name)::int as grouping_level
    from {SALES} group by rollup (r_name, n_name)""")
def worksheet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = worksheet.with_totals(sales(spark, sf_dir), ["r_name", "n_name"], [Measure("revenue", net())])
    return out.withColumn("revenue", F.round("revenue", 2))


@query("""select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus, o_orderpriority)::int as grouping_level
    from orders group by cube (o_orderstatus, o_orderpriority)""")
def worksheet_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worksheet.with_totals(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], [Measure("n", F.lit(1), "cnt")], cube=True)


@query("""with c as (select o_custkey, sum(o_totalprice) as total, min(o_orderdate) as first from orders group by 1)
    select year(first)::int as cohort, count(*) as orders, round(avg(total), 2) as mean_customer_total from orders join c using (o_custkey) group by 1""")
def fixed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = worksheet.with_fixed(table(spark, sf_dir, "orders"), ["o_custkey"], Measure("customer_total", F.col("o_totalprice")), Measure("first", F.col("o_orderdate"), "min"))
    out = orders.groupBy(F.year("first").alias("cohort")).agg(F.count("*").alias("orders"), F.avg("customer_total").alias("mean_customer_total"))
    return out.withColumn("mean_customer_total", F.round("mean_customer_total", 2))


@query("""with t as (select r_name, year(o_orderdate)::int as y, sum((l_quantity)::bigint)::bigint as quantity from """ + SALES + """ group by 1, 2)
    select r_name, y, quantity, (row_number() over o)::int as index, (1 - row_number() over o)::int as first, (count(*) over p - row_number() over o)::int as last,
      count(*) over p as size, (sum(quantity) over (o rows unbounded preceding))::bigint as running_sum,
      round(avg(quantity) over (o rows 2 preceding), 4) as moving_avg, max(quantity) over (o rows unbounded preceding) as running_max,
      (rank() over (partition by r_name order by quantity desc))::int as rank, round(quantity / sum(quantity) over p, 6) as share,
      lag(quantity) over o as previous, lead(quantity) over o as next, round((quantity - lag(quantity) over o) / abs(lag(quantity) over o), 6) as difference
    from t window p as (partition by r_name), o as (partition by r_name order by y)""")
def table_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = sales(spark, sf_dir).groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    out = worksheet.table_calculations(shown, "quantity", [F.col("y")], ["r_name"])
    return out.withColumns({"moving_avg": F.round("moving_avg", 4), "share": F.round("share", 6), "difference": F.round("difference", 6)})


@query("""select case when o_totalprice > 200000 then 'large' when o_totalprice > 50000 then 'medium' else 'small' end as size_class,
      upper(left(o_orderpriority, 1)) || '/' || o_orderstatus as tag, count(*) as n, max(date_diff('day', o_orderdate::date, (o_orderdate + interval 10 day)::date))::int as days
    from orders where o_orderstatus in ('F', 'O') and not o_orderpriority = '5-LOW' and o_totalprice between 1000 and 300000 group by 1, 2""")
def calculated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    kept = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW") & price.between(1000, 300000))
    size_class = F.when(price > 200000, "large").when(price > 50000, "medium").otherwise("small")
    tag = F.concat(F.upper(F.left("o_orderpriority", F.lit(1))), F.lit("/"), "o_orderstatus")
    later = F.col("o_orderdate") + F.expr("interval 10 days")
    return kept.groupBy(size_class.alias("size_class"), tag.alias("tag")).agg(F.count("*").alias("n"), F.max(F.datediff(later, "o_orderdate")).alias("days"))


WIDE_SQL = "select l_returnflag, sum(l_quantity::bigint)::double as quantity, count(*)::double as lines, count(distinct l_orderkey)::double as orders from lineitem group by 1"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders")
    )


@query(f"""with w as ({WIDE_SQL}), l as (unpivot w on quantity, lines, orders into name series value value)
    select l_returnflag as category, series, value, round(value / sum(value) over (partition by l_returnflag), 6) as share from l""")
def melted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.stacked_shares(reshape.melt(_wide(spark, sf_dir), "l_returnflag")).withColumn("share", F.round("share", 6))


@query("""select c_mktsegment, count(*) filter (n_regionkey = 0) as r0, count(*) filter (n_regionkey = 1) as r1, count(*) filter (n_regionkey = 2) as r2
    from customer join nation on c_nationkey = n_nationkey where n_regionkey < 3 group by 1""")
def spread_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").filter("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = joined.groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"))
    out = reshape.spread(counted, "c_mktsegment", "n_regionkey", "n", [0, 1, 2])
    return out.select("c_mktsegment", *(F.coalesce(str(i), F.lit(0)).alias(f"r{i}") for i in range(3)))


@query("""select o_custkey, o_orderkey, n, (2 * (row_number() over w - 1) + coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as row_offset
    from (select o_custkey, o_orderkey, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2) window w as (partition by o_custkey order by o_orderkey)""")
def series_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))
    return reshape.series_offsets(n, idx="o_orderkey", chart="o_custkey")


@query("""select p_partkey, p_partkey % 16384 + 1 as n,
      case when (p_partkey % 16384) >= 702 then chr((65 + ((p_partkey % 16384) - 702) // 676)::int) else '' end
      || case when (p_partkey % 16384) >= 26 then chr((65 + ((p_partkey % 16384) // 26 - 1) % 26)::int) else '' end || chr((65 + (p_partkey % 16384) % 26)::int) as letters,
      (p_partkey % 16384 + 1)::int as back, date_diff('day', date '1899-12-31', date '1900-01-01' + (p_partkey % 100)::int) + case when p_partkey % 100 >= 59 then 1 else 0 end as serial
    from part""")
def sheet_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 16384 + 1
    letters = values.column_letters(n)
    date = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("p_partkey") % 100).cast("int"))
    serial = values.spreadsheet_serial(date).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), letters.alias("letters"), values.column_number(letters).alias("back"), serial.alias("serial"))


@query("""select p_type, count(*) filter (s = 100) as equal, count(*) filter (s = 50) as begins, count(*) filter (s = 20) as contains, count(*) filter (s = 0) as nothing
    from (select p_type, case when lower(p_name) = 'part 1' then 100 when starts_with(lower(p_name), 'part 1') then 50 when contains(lower(p_name), 'part 1') then 20 else 0 end as s from part) group by 1""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "part").select("p_type", text.search_score(F.col("p_name"), "part 1").alias("s"))
    return scored.groupBy("p_type").agg(*(F.count_if(F.col("s") == s).alias(n) for n, s in (("equal", 100), ("begins", 50), ("contains", 20), ("nothing", 0))))
