"""Spend, rates, sessions and joined events over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import relate, spend
from ..sources.files import table
from ..streaming import events as streams
from .registry import query

CENTS_SQL = "round(value * 100)::bigint"


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("long")


#: Prices of this query: the longest part of a model's name holds.
SHEET = [("click", "c", 0.003, 0.015), ("click", "cli", 0.015, 0.075), ("view", "", 0.0, 0.0), ("purchase", "cha", 0.0025, 0.01), ("purchase", "purchase-1", 0.03, 0.06)]


@query(f"""with p(nth, provider, part, i, o) as (values {", ".join(str((n, p, m, round(i * 10**9), round(o * 10**9))) for n, (p, m, i, o) in enumerate(SHEET))}),
    c as (select event_id, event_type as provider, event_type || '-' || user_id % 3 as model, event_id % 5000 as tokens_in, user_id % 900 as tokens_out from events),
    m as (select model, provider, arg_max((i, o), (length(part), -nth)) as r from (select distinct provider, model from c) join p using (provider) where contains(model, part) group by 1, 2)
    select provider, model, count(*) as calls, ((sum(coalesce(tokens_in * r[1] + tokens_out * r[2], 0))::bigint + 50000000) // 100000000 / 10000.0)::double as cost from c left join m using (provider, model) group by 1, 2""")
def priced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string"))
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), model.alias("model"), (F.col("event_id") % 5000).alias("input_tokens"), (F.col("user_id") % 900).alias("output_tokens"))
    sheet = spark.createDataFrame([(n, *x) for n, x in enumerate(SHEET)], "nth int, provider string, part string, in_per_1k double, out_per_1k double")
    return spend.priced(calls, sheet).groupBy("provider", "model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).cast("double").alias("cost"))


@query(f"""with c as (select event_id, user_id, {CENTS_SQL} as cents, epoch_us(ts) as us from events),
    s as (select event_id, user_id, cents, coalesce(sum(cents) over (partition by user_id order by us range between 604800000000 preceding and 1 preceding), 0)::bigint as before from c)
    select event_id, user_id, cents, before, before + cents as after, ((before + cents) // 2000 * 2000)::bigint as band from s where (before + cents) // 2000 > before // 2000""")
def crossed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", cents().alias("cents"))
    return spend.crossed_bands(calls, "user_id", "ts", "cents", 2000).drop("ts")


@query(f"""select user_id, date_trunc('month', ts)::timestamp as month, sum({CENTS_SQL})::bigint as cents, count(*) as calls, count(*) filter (event_type = 'error') as errors, max(ts)::date as today,
      round(sum({CENTS_SQL})::bigint / day(max(ts)) * day(last_day(max(ts))), 4) as projected from events group by 1, 2""")
def spend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.sum(cents()).alias("cents"), F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").cast("date").alias("today")
    )
    return spend.projected(grouped, "cents", "today").withColumn("projected", F.round("projected", 4))


@query(f"""with t as (select user_id, date_trunc('month', ts)::timestamp as month, sum({CENTS_SQL})::bigint as cents from events group by 1, 2)
    select user_id, month, cents, (unnest(range(1, cents // 10000 + 1)) * 10000.0)::double as threshold from t where cents >= 10000""")
def spend_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.sum(cents()).alias("cents"))
    return spend.thresholds(totals, "user_id", "month", "cents", 10000.0)


@query(f"""with u as (select user_id, count(*) filter (ts >= timestamp '2024-01-30') as day_tokens, count(*) as month_tokens, coalesce(sum({CENTS_SQL}) filter (ts >= timestamp '2024-01-30'), 0)::bigint as day_usd, sum({CENTS_SQL})::bigint as month_usd from events group by 1),
    l as (select *, case when user_id % 2 = 0 then 1 else 5 end as a, 100 as b, case when user_id % 3 = 0 then 50 else 100000 end as c, 60000 as d from u)
    select user_id, case when day_tokens + 1 > a then 'day_tokens' when month_tokens + 1 > b then 'month_tokens' when day_usd + 10 > c then 'day_usd' when month_usd + 10 > d then 'month_usd' end as reason, reason is null as allowed,
      greatest(0, a - day_tokens)::double as left_day_tokens, greatest(0, b - month_tokens)::double as left_month_tokens, greatest(0, c - day_usd)::double as left_day_usd, greatest(0, d - month_usd)::double as left_month_usd from l""")
def budget_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.col("ts") >= F.lit("2024-01-30").cast("timestamp")
    usage = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(today).alias("day_tokens"), F.count("*").alias("month_tokens"), F.coalesce(F.sum(F.when(today, cents())), F.lit(0)).alias("day_usd"), F.sum(cents()).alias("month_usd"))
    user = F.col("user_id")
    none = F.lit(None).cast("double")
    limits = usage.select(user, F.when(user % 2 == 0, 1.0).alias("day_tokens"), none.alias("month_tokens"), F.when(user % 3 == 0, 50.0).alias("day_usd"), none.alias("month_usd"))
    out = spend.budget_check(usage, limits, "user_id", 1, 10.0, {"day_tokens": 5.0, "month_tokens": 100.0, "day_usd": 100000.0, "month_usd": 60000.0})
    return out.select("user_id", "reason", "allowed", *(F.col(f"left_{n}") for n in ("day_tokens", "month_tokens", "day_usd", "month_usd")))


@query(f"""with e as (select user_id, {CENTS_SQL} as cents, unnest([time_bucket(interval 1 day, ts) - to_days(i::int) for i in range(7)]) as window_start from events)
    select user_id, window_start::timestamp as window_start, count(*) as n, sum(cents)::bigint as cents from e group by 1, 2""")
def rolling_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.rolling_spend(table(spark, sf_dir, "events"), "user_id", "ts", cents())


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 12 hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts)::timestamp as started, (max(ts) + interval 12 hour)::timestamp as evicted, count(*) as n from (select user_id, ts, max(k) over (partition by user_id, ts) as k from s) group by user_id, k""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "user_id", "ts", idle="12 hours")


@query("""select p.event_id, p.user_id, p.ts::timestamp as ts, c.event_id as last_event_id from (select * from events where event_type = 'purchase') p
    asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by 1, 2) c on p.user_id = c.user_id and p.ts >= c.ts""")
def last_view_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relate.as_of(bought, events.filter("event_type = 'view'").select("event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"])


BOXES = "select s_suppkey as box_id, (s_suppkey * 37 % 100)::double as x0, (s_suppkey * 53 % 100)::double as y0, x0 + 5 + s_suppkey % 7 as x1, y0 + 4 + s_suppkey % 5 as y1 from supplier"


@query(f"""with b as ({BOXES}), p as (select p_partkey as point_id, (p_partkey * 7 % 1100) / 10.0 as x, (p_partkey * 13 % 1090) / 10.0 as y from part)
    select point_id, min(box_id) as box_id from p join b on x between x0 - 2 and x1 + 2 and y between y0 - 2 and y1 + 2 group by 1""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(key.alias("box_id"), (key * 37 % 100).cast("double").alias("x0"), (key * 53 % 100).cast("double").alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 5 + F.col("box_id") % 7, "y1": F.col("y0") + 4 + F.col("box_id") % 5})
    part = F.col("p_partkey")
    points = table(spark, sf_dir, "part").select(part.alias("point_id"), (part * 7 % 1100 / 10.0).alias("x"), (part * 13 % 1090 / 10.0).alias("y"))
    return relate.points_in_boxes(points, boxes, cell=10.0, slack=2.0)


HEX_SQL = "printf('#%02X%02X%02X', (p_size * 5)::int % 256, (p_partkey * 3 % 256)::int, (p_partkey * 11 % 256)::int)"
PALETTE = ["#000000", "#3B82F6", "#10B981", "#F59E0B", "#EF4444", "#FFFFFF"]


@query(f"""with c as (select distinct {HEX_SQL} as colour from part), p(entry) as (values {", ".join(f"('{x}')" for x in PALETTE)}),
    x as (select colour, entry, sqrt(sum(d * d) / 3) as distance from (select colour, entry, unnest([(('0x' || colour[i:i + 1])::int - ('0x' || entry[i:i + 1])::int) / 255 for i in [2, 4, 6]]) as d from c, p) group by 1, 2)
    select colour, arg_min(entry, (distance, entry)) as entry, round(min(distance), 6) as distance from x group by 1""")
def nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    channels = [F.lpad(F.hex(c.cast("long")), 2, "0") for c in (F.col("p_size") * 5 % 256, part * 3 % 256, part * 11 % 256)]
    colours = table(spark, sf_dir, "part").select(F.concat(F.lit("#"), *channels).alias("colour"))
    palette = spark.createDataFrame([(x,) for x in PALETTE], "entry string")
    found = relate.nearest(colours, "colour", palette, "entry", values.colour_distance(F.col("colour"), F.col("entry")))
    return found.withColumn("distance", F.round("distance", 6))


@query("""with recursive n as (select p_partkey as node, case when p_partkey > 1 then p_partkey // 3 end as parent, case when p_partkey % 50 = 7 then p_brand end as style from part),
    w as (select node as start, parent, style from n union all select w.start, n.parent, n.style from w join n on w.parent = n.node where w.style is null)
    select start as node, coalesce(max(style), 'default') as style from w group by 1""")
def inherited_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(key.alias("node"), F.when(key > 1, F.floor(key / 3)).alias("parent"), F.when(key % 50 == 7, F.col("p_brand")).alias("style"))
    return relate.inherited(nodes, "node", "parent", "style", "default")


@query("""select event_type, props, count(*) as n from (select event_type, (props->>'k')::bigint % 10 as props from events) group by 1, 2""")
def variant_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("props")).agg(F.count("*").alias("n"))
