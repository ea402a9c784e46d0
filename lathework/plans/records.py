"""Queries on logs, limits, geometry of pages, stored roll-ups and workbooks' metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry, history
from ..operators.sketches import Rollup
from ..sources import workbooks
from ..sources.files import table
from ..streaming import states
from .registry import query
from .usage import CENTS_SQL, cents

#: Accepted requests (d: do, u: undo, r: redo), over and over; each is possible where it stands.
PATTERNS = ("ddurdudurd", "dduurrduur", "dudurdduru")


@query(f"""with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n, [{", ".join(f"'{p}'" for p in PATTERNS)}][user_id % 3 + 1] as p from events),
    o as (select user_id, event_id, n, p[(n - 1) % 10 + 1] as op from e),
    s(user_id, event_id, n, undo, redo) as (select user_id, null::bigint, 0::bigint, []::bigint[], []::bigint[] from (select distinct user_id from o) union all
      select o.user_id, o.event_id, o.n, case o.op when 'd' then list_append(undo, o.event_id) when 'u' then undo[1:len(undo) - 1] else list_append(undo, redo[len(redo)]) end,
        case o.op when 'd' then [] when 'u' then list_append(redo, undo[len(undo)]) else redo[1:len(redo) - 1] end from s join o on o.user_id = s.user_id and o.n = s.n + 1)
    select user_id, event_id, len(undo)::bigint as undo_depth, len(redo)::bigint as redo_depth, undo[len(undo)] as current from s where n > 0""")
def undo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep the undo and redo stacks are after each request, and which step is in force."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    pattern = F.get(F.array(*map(F.lit, PATTERNS)), (F.col("user_id") % 3).cast("int"))
    letter = F.substring(pattern, nth % 10 + 1, F.lit(1))
    op = F.when(letter == "d", "do").when(letter == "u", "undo").otherwise("redo")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", op.alias("op"))
    out = history.undone(log, "user_id", ["ts", "event_id"], "op")
    return out.select("user_id", "event_id", "undo_depth", "redo_depth", F.col("current.event_id").alias("current"))


@query("""with recursive w as (select p_partkey as id, p_partkey // 200 as block, row_number() over (partition by p_partkey // 200 order by p_partkey) as n, 'title ' || p_partkey * 37 % 61 || ' of ' || p_partkey // 200 as name,
      case when p_partkey % 5 = 0 then '' else (p_partkey * 53 % 47)::varchar end as ids, p_partkey % 17 = 0 as auto from part),
    r(block, id, n, names, sets, kept) as (select block, null::bigint, 0::bigint, []::varchar[], []::varchar[], false from (select distinct block from w) union all
      select w.block, w.id, w.n, case when not w.auto and not list_contains(names, w.name) and not list_contains(sets, w.ids) then list_append(names, w.name) else names end,
        case when not w.auto and not list_contains(names, w.name) and not list_contains(sets, w.ids) and w.ids <> '' then list_append(sets, w.ids) else sets end,
        w.auto or (not list_contains(names, w.name) and not list_contains(sets, w.ids)) from r join w on w.block = r.block and w.n = r.n + 1)
    select id as p_partkey from r where kept""")
def consolidated_wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wants whose name or set of ids no earlier want that stayed has; those of rules stay always."""
    key = F.col("p_partkey")
    block = F.floor(key / 200).cast("long")
    plain = F.concat_ws(" ", F.lit("Title"), (key * 37 % 61).cast("string"), F.lit("of"), block.cast("string"))
    name = F.when(key % 3 == 0, F.concat(plain, F.lit("  Placeholder"))).when(key % 3 == 1, F.concat(F.lit("Small "), plain)).otherwise(plain)
    first = block * 1000 + key * 53 % 47
    ids = F.when(key % 5 == 0, F.array().cast("array<bigint>")).when(key % 2 == 0, F.array(first, -first - 1)).otherwise(F.array(-first - 1, first, first))
    wants = table(spark, sf_dir, "part").select(key, name.alias("name"), ids.alias("ids"))
    same_set = F.when(F.size("ids") > 0, F.array_join(F.sort_array(F.array_distinct("ids")), ","))
    keys = {"name": history.want_name(F.col("name")), "ids": same_set}
    return history.first_without_conflict(wants, "p_partkey", keys, key % 17 == 0).select("p_partkey")


@query("""with l as (select l_suppkey as page, l_orderkey % 7 as block_id, (l_partkey * 7 % 1000) / 10.0 + 2.5 as x, (l_orderkey * 13 % 1000) / 10.0 + 0.5 as y, l_quantity > 5 as filled, row_number() over () as i from lineitem),
    b as (select s_suppkey as page, k as box_id, (s_suppkey * 37 + k * 11) % 100 as x0, (s_suppkey * 53 + k * 17) % 100 as y0, 0.5 * pow(2, k % 8) as size from supplier, range(12) r(k)),
    c as (select l.page, block_id, i, filled, max(box_id is not null) as placed from l left join b on l.page = b.page and x between x0 - 2 and x0 + size + 2 and y between y0 - 2 and y0 + size + 2 group by all)
    select page, block_id, count(*) filter (filled) as lines, count(*) filter (filled and placed) as placed, coalesce(count(*) filter (filled and placed) / nullif(count(*) filter (filled), 0) >= 0.8, false) as consumed from c group by 1, 2""")
def consumed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text of which at least 80 % of the lines lie in cells, among cells of very unequal size."""
    page, order, part = (F.col(f"l_{c}key") for c in ("supp", "order", "part"))
    x, y = (part * 7 % 1000) / 10.0, (order * 13 % 1000) / 10.0
    lines = table(spark, sf_dir, "lineitem").select(page.alias("page"), (order % 7).alias("block_id"), F.struct(order, "l_linenumber", part).alias("line_id"), x.alias("x0"), y.alias("y0"), (x + 5.0).alias("x1"), (y + 1.0).alias("y1"), "l_quantity")
    key, k = F.col("s_suppkey"), F.col("k")
    boxes = table(spark, sf_dir, "supplier").select(key, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    boxes = boxes.select(key.alias("page"), k.alias("box_id"), ((key * 37 + k * 11) % 100).cast("double").alias("x0"), ((key * 53 + k * 17) % 100).cast("double").alias("y0"), (0.5 * F.pow(F.lit(2.0), k % 8)).alias("size"))
    boxes = boxes.withColumns({"x1": F.col("x0") + F.col("size"), "y1": F.col("y0") + F.col("size")}).drop("size")
    return geometry.consumed_blocks(lines, boxes, ["page"], F.col("l_quantity") > 5, finest=1.0)


@query("""with recursive l as (select l_suppkey as page, (l_partkey % 97)::double as x0, (l_orderkey % 50)::double as y0, (l_partkey % 97) + 1.0 + l_linenumber as x1, (l_orderkey % 50) + 1.0 as y1 from lineitem),
    v as (select page, x0, row_number() over (partition by page order by x0) as i from (select distinct page, x0 from l)),
    c(page, i, x0, first) as (select page, i, x0, x0 from v where i = 1 union all select v.page, v.i, v.x0, case when v.x0 - c.first <= 12 then c.first else v.x0 end from c join v on v.page = c.page and v.i = c.i + 1),
    g as (select l.page, first, min(l.x0) as x0, min(y0) as y0, max(x1)::double as x1, max(y1)::double as y1, count(*) as lines from l join c on c.page = l.page and c.x0 = l.x0 group by 1, 2)
    select page, (row_number() over (partition by page order by first) - 1)::int as col, x0, y0, x1, y1, lines from g""")
def text_column_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of text on pages by where lines start, and the box around each."""
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_orderkey") % 50).cast("double")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 1 + F.col("l_linenumber")).alias("x1"), (y + 1).alias("y1"))
    return geometry.text_columns(lines, ["page"], gap=24)


def event_rollup() -> Rollup:
    """Events by day and kind: how many, their cents, their users and how their values are spread."""
    return Rollup(levels={"day": F.to_date("ts"), "event_type": F.col("event_type")}, counts={"n": None, "large": F.col("value") > 50}, sums={"cents": cents()}, distinct={"users": F.col("user_id")}, spread={"value": F.col("value")})


@query(f"""select event_type, count(*) as n, count(*) filter (value > 50) as large, sum({CENTS_SQL})::bigint as cents, count(distinct user_id) as users, true as users_close, true as median_close from events group by 1""")
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up by day and kind, rolled up by kind, and whether its estimates are as close to the exact answers as sketches promise.

    HyperLogLog: within 5 % (3 standard errors); KLL: the estimated median's rank within 3 % of the middle.
    """
    events, rollup = table(spark, sf_dir, "events"), event_rollup()
    told = rollup.answers(rollup.rolled_up(rollup.built(events), ["event_type"])).withColumnRenamed("users", "about")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    below = events.join(told.select("event_type", "value_p50"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("value_p50")).cast("int")).alias("share"))
    both = told.join(exact, "event_type").join(below, "event_type")
    close = F.abs(F.col("about") - F.col("users")) <= F.greatest(0.05 * F.col("users"), F.lit(1))
    return both.select("event_type", "n", "large", "cents", "users", close.alias("users_close"), (F.abs(F.col("share") - 0.5) <= 0.03).alias("median_close"))


def nation_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, xml: a workbook for each nation, with suppliers as columns of a datasource and customers' segments as relations."""
    key = F.col("s_suppkey")
    calculated = F.when(key % 3 == 0, F.concat(F.lit("<calculation class='tableau' formula='[a] &lt; "), key.cast("string"), F.lit("'>"), F.when(key % 2 == 0, "<table-calc type='Rows'/>").otherwise(""), F.lit("</calculation>"))).otherwise("")
    alias = F.when(key % 4 == 1, F.concat(F.lit("<aliases><alias key='k' value='v"), key.cast("string"), F.lit("'/></aliases>"))).otherwise("")
    role = F.when(key % 2 == 0, "measure").otherwise("dimension")
    column = F.concat(F.lit("<column name='["), "s_name", F.lit("]' datatype='real' role='"), role, F.lit("' ordinal='"), key.cast("string"), F.lit("'>"), calculated, alias, F.lit("</column>"))
    columns = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, column.alias("x")))), lambda c: c["x"]), "").alias("columns"))
    relation = F.concat(F.lit("<relation name='"), "c_mktsegment", F.lit("' table='[t].["), "c_mktsegment", F.lit("]' type='table'><columns><column name='c' datatype='string'/><column name='n'/></columns></relation>"))
    segments = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("m"))
    named = segments.groupBy("n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", relation.alias("x")))), lambda c: c["x"]), "").alias("relations"))
    head = F.concat(F.lit("<?xml version='1.0'?><workbook version='18.1'><preferences/><datasources><datasource caption='"), F.replace("n_name", F.lit(" "), F.lit("&amp;")), F.lit("' name='ds' version='18.1'>"))
    connection = F.concat(F.lit("<connection class='federated'><named-connections><named-connection caption='c' name='inner'><connection class='csv' dbname='db' server='host'>"), F.coalesce("relations", F.lit("")), F.lit("</connection></named-connection></named-connections></connection>"))
    rows = table(spark, sf_dir, "nation").join(columns, "n_nationkey", "left").join(named, "n_nationkey", "left")
    return rows.select("n_nationkey", F.concat(head, connection, F.coalesce("columns", F.lit("")), F.lit("</datasource></datasources><worksheets/></workbook>")).alias("xml"))


@query("""select s_nationkey::int as n_nationkey, 'ds' as source, replace(n_name, ' ', '&') as caption, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as nth, '[' || s_name || ']' as name, case when s_suppkey % 2 = 0 then 'measure' else 'dimension' end as role, s_suppkey::int as ordinal,
      case when s_suppkey % 3 = 0 then '[a] < ' || s_suppkey end as formula, s_suppkey % 6 = 0 as has_table_calc, case when s_suppkey % 4 = 1 then 'k=v' || s_suppkey else '' end as aliases from supplier join nation on n_nationkey = s_nationkey""")
def workbook_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the datasources that workbooks (XML) describe."""
    sources = workbooks.datasources(nation_workbooks(spark, sf_dir), "n_nationkey")
    captions = sources.select("n_nationkey", F.col("caption").alias("of_source"))
    columns = workbooks.source_columns(sources, "n_nationkey").join(captions, "n_nationkey")
    aliases = F.array_join(F.transform(F.coalesce("aliases", F.array().cast("array<struct<key:string,value:string>>")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return columns.select("n_nationkey", "source", F.col("of_source").alias("caption"), "nth", "name", "role", "ordinal", "formula", "has_table_calc", aliases.alias("aliases"))


@query("""select distinct c_nationkey::int as n_nationkey, 'ds' as source, c_mktsegment as name, '[t].[' || c_mktsegment || ']' as "table", 'table' as type, 'c,n' as columns from customer""")
def workbook_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of the connections that workbooks describe, those of named connections among them."""
    sources = workbooks.datasources(nation_workbooks(spark, sf_dir), "n_nationkey")
    return workbooks.relations(sources, "n_nationkey").select("n_nationkey", "source", "name", "table", "type", F.array_join("columns", ",").alias("columns"))


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) / 1000000.0::double as sec, row_number() over (partition by user_id order by epoch_us(ts), event_id) as n from events),
    s(user_id, event_id, n, tokens, last, over, accepted) as (select user_id, null::bigint, 0::bigint, 2.0::double, null::double, []::double[], false from (select distinct user_id from e) union all
      select user_id, event_id, n, case when have >= 1 then have - 1 else have end, sec, case when have >= 1 then over else list_filter(list_append(over, sec), lambda x: x >= sec - 432000) end, have >= 1
      from (select e.user_id, e.event_id, e.n, e.sec, over, case when last is null then tokens else least(2.0::double, tokens + greatest(0, e.sec - last) * 0.00001::double) end as have from s join e on e.user_id = s.user_id and e.n = s.n + 1))
    select user_id as key, event_id, accepted, len(over)::int as overflows, len(over) >= 3 as ends from s where n > 0""")
def limited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a token bucket a user, and how many overflows of the trailing days count."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return states.limited_table(events, capacity=2.0, rate=0.00001, window=432000.0, most=3)


@query("""with recursive e as (select user_id, event_id, event_type, epoch_us(ts) / 1000000.0::double as sec, row_number() over (partition by user_id order by epoch_us(ts), event_id) as n from events),
    s(user_id, event_id, event_type, sec, n, first) as (select user_id, event_id, event_type, sec, n, sec from e where n = 1 union all
      select e.user_id, e.event_id, e.event_type, e.sec, e.n, case when e.sec > s.first + 86400 then e.sec else s.first end from s join e on e.user_id = s.user_id and e.n = s.n + 1),
    g as (select user_id, first, arg_max(event_type, (sec, event_id)) as value from s group by 1, 2), l as (select *, lag(value) over (partition by user_id order by first) as before from g)
    select user_id as key, make_timestamp((round((first + 86400) * 1000000))::bigint) as saved_at, value from l where value is distinct from before""")
def saved_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a timer of a day, set by the first change since the last save, saves of each user; equal values are saved once."""
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", F.col("event_type").alias("value"))
    return states.saved_table(changes, every=86400.0)
