"""Audit, suggestion, comparison and refresh queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audits, clusters
from ..sources.files import table
from .elements import ELEMENTS_SQL, elements
from .registry import query


@query("""with s as (select o_custkey, o_orderstatus, list(o_totalprice - 100000 order by o_orderkey) as v from orders group by 1, 2)
    select o_custkey, count(*) as n_series, sum(len(v))::bigint as n_points, count(*) filter (len(v) <> 5) as mismatched, count(*) filter (len(list_filter(v, lambda x: x < 0)) > 0) as with_negatives, count(distinct len(v)) = 1 as even from s group by 1""")
def chart_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(F.col("o_totalprice") - 100000).alias("values"), F.lit(5).alias("n_categories"))
    return audits.series_facts(series, "o_custkey")


@query("""select l_suppkey, (max(l_linenumber) + 1)::int as n_rows, (max(l_partkey % 8) + 1)::bigint as n_cols, count(*) as n_cells, count(*) filter (l_returnflag <> 'A') as with_text, count(*) filter (l_linestatus = 'O') as filled, count(*) filter (l_tax > 0.03) as bordered from lineitem group by 1""")
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 8).alias("col"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("").alias("text"), F.when(F.col("l_linestatus") == "O", "x").alias("fill"), F.when(F.col("l_tax") > 0.03, 1).alias("border")
    )
    return audits.cell_facts(cells, "l_suppkey")


@query("""select event_type, count(*) as n, count(*) filter (value >= 20) as n_ok, count(*) filter (not value >= 20) as n_failed from events group by 1 order by n desc, event_type limit 4""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.tallied(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 20, top=4)


@query("""with s as (select 'empty text' as what, 'high' as severity, doc_id from documents where coalesce(text, '') = '' union all select 'long text', 'medium', doc_id from documents where n_chars > 12000 union all select 'short text', 'low', doc_id from documents where n_chars between 1 and 400)
    select what, severity, doc_id from s order by case severity when 'high' then 1 when 'medium' then 2 else 3 end, doc_id, what limit 30""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    rule = lambda what, severity, where: docs.filter(where).select(F.lit(what).alias("what"), F.lit(severity).alias("severity"), "doc_id")
    return audits.suggestions([rule("empty text", "high", F.coalesce("text", F.lit("")) == ""), rule("long text", "medium", n > 12000), rule("short text", "low", n.between(1, 400))], ["doc_id", "what"])


NAMES_SQL = "select 'part' as kind, p_partkey as id, p_name as name from part union all select 'customer', c_custkey, c_name from customer union all select 'supplier', s_suppkey, s_name from supplier"


@query(f"""with s as (select *, case when lower(name) = 'supplier#00000000' then 100 when starts_with(lower(name), 'supplier#00000000') then 50 when contains(lower(name), 'supplier#00000000') then 20 else 0 end as score from ({NAMES_SQL}))
    select kind, id, score::int as score from s where score > 0 order by score desc, kind, id limit 30""")
def search_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search over several kinds of things."""
    named = lambda name, key, of: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("id"), F.col(of).alias("name"))
    every = named("part", "p_partkey", "p_name").unionByName(named("customer", "c_custkey", "c_name")).unionByName(named("supplier", "s_suppkey", "s_name"))
    scored = every.withColumn("score", text.search_score(F.col("name"), "Supplier#00000000")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "kind", "id").limit(30).drop("name")


TOKENS_SQL = f"list_filter(list_distinct([lower(w) for w in regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_]+')]), lambda w: not list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], w))"


@query(f"""with d as (select doc_id, {TOKENS_SQL} as t from documents)
    select a.doc_id, len(list_intersect(a.t, b.t))::int as shared, (len(a.t) - len(list_intersect(a.t, b.t)))::int as only_here, (len(b.t) - len(list_intersect(a.t, b.t)))::int as only_next from d a join d b on b.doc_id = a.doc_id + 1""")
def shared_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.search_tokens(F.col("text")).alias("here"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("here").alias("next"))
    n = lambda c: F.size(c)
    return docs.join(after, "doc_id").select("doc_id", n(F.array_intersect("here", "next")).alias("shared"), n(F.array_except("here", "next")).alias("only_here"), n(F.array_except("next", "here")).alias("only_next"))


@query("""select (select count(*) from customer) as people, (select count(*) from orders) as documents, (select count(distinct user_id) from events where ts >= timestamp '2024-01-29') as active, (select round(sum(o_totalprice), 2) from orders where o_orderstatus = 'F') as cost, (select count(*) from orders where o_orderstatus = 'F') as calls""")
def admin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").agg(F.count("*").alias("people"))
    done = F.col("o_orderstatus") == "F"
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("documents"), F.round(F.sum(F.when(done, F.col("o_totalprice"))), 2).alias("cost"), F.count_if(done).alias("calls"))
    active = table(spark, sf_dir, "events").filter("ts >= timestamp_ntz '2024-01-29'").agg(F.count_distinct("user_id").alias("active"))
    # One row each.
    return people.join(F.broadcast(orders)).join(F.broadcast(active)).select("people", "documents", "active", "cost", "calls")


@query("""with t as (select c_nationkey, count(*) as n from customer group by 1) select c_nationkey, n, round(n / sum(n) over (), 6) as share, case when n / sum(n) over () >= 0.04 then round(100 * n / sum(n) over (), 0)::int || '%' end as label from t""")
def pie_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return audits.labelled_shares(counts, "n").withColumn("share", F.round("share", 6))


@query(f"""with e as ({ELEMENTS_SQL}), a as (select page, kind, count(*) as n_before from e where element_id % 11 <> 3 group by 1, 2), b as (select page, kind, count(*) as n_after from e where element_id % 13 <> 5 and page <> 7 group by 1, 2)
    select page, kind, coalesce(n_before, 0) as n_before, coalesce(n_after, 0) as n_after from a full join b using (page, kind) where coalesce(n_before, 0) <> coalesce(n_after, 0)""")
def pages_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = elements(spark, sf_dir)
    return audits.structure_changes(every.filter("element_id % 11 <> 3"), every.filter("element_id % 13 <> 5 and page <> 7"), "page", "kind")


@query("""with o as (select o_orderkey, case when o_orderkey % 2 = 0 then n_nationkey else 1000 + o_custkey end as g from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
    m as (select s_nationkey as g, s_suppkey from supplier)
    select o_orderkey, coalesce(s_suppkey, o.g)::bigint as target from o left join m on m.g = o.g""")
def expanded_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    target = F.when(F.col("o_orderkey") % 2 == 0, F.col("c_nationkey").cast("long")).otherwise(F.col("o_custkey") + 1000)
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("g"), "s_suppkey")
    return audits.expanded(orders.select("o_orderkey", target.alias("g")), members, "g", "s_suppkey").select("o_orderkey", "target")


@query("""with m as (select o_custkey, max(o_orderkey) as most from orders where o_orderstatus = 'F' group by 1) select o_custkey, o_orderkey as old, coalesce(most, 0) + row_number() over (partition by o_custkey order by o_orderkey) as id from orders left join m using (o_custkey) where o_orderstatus <> 'F'""")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderkey").alias("old"))
    return audits.with_next_ids(new, orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("id")), "o_custkey", "id", ["old"])


@query("""with a as (select p_partkey, p_size * 2 as p_size, case when p_size * 2 > 60 then 'XL' else p_brand end as p_brand from part)
    select p.p_partkey, 'modified' as change, concat_ws(',', case when p.p_size <> a.p_size then 'p_size' end, case when p.p_brand <> a.p_brand then 'p_brand' end) as fields from part p join a using (p_partkey) where p.p_size <> a.p_size or p.p_brand <> a.p_brand""")
def refresh_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scripts in order, one that is switched off, and what they changed."""
    scripts = [
        audits.Script("label", lambda df: df.withColumn("p_brand", F.when(F.col("p_size") > 60, "XL").otherwise(F.col("p_brand"))), order=2),
        audits.Script("double", lambda df: df.withColumn("p_size", F.col("p_size") * 2), order=1),
        audits.Script("off", lambda df: df.limit(0), enabled=False),
    ]
    return audits.refreshed_by(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), scripts, "p_partkey", ["p_size", "p_brand"])[1]


@query("""with k as (select l_orderkey, l_linenumber as nth from lineitem where l_returnflag = 'R'), w as (select o_orderkey as l_orderkey, unnest(range(1, (o_orderkey % 5 + 1)::bigint))::int as nth from orders)
    select l_orderkey, nth, true as locked from k union all select l_orderkey, nth, false from w where not exists (select 1 from k where k.l_orderkey = w.l_orderkey and k.nth = w.nth)""")
def regenerated_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5).alias("wanted"))
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("nth"), (F.col("l_returnflag") == "R").alias("locked"))
    return audits.regenerated(groups, children, "l_orderkey", "wanted")


@query("""with s as (select l_suppkey, l_orderkey, count(*) as n from lineitem group by 1, 2), o as (select *, (2 * (row_number() over w - 1) + coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as begun from s window w as (partition by l_suppkey order by l_orderkey)),
    p as (select l_suppkey, l_orderkey, l_linenumber::double as x, l_quantity as y, l_tax as z, row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber, l_quantity, l_tax) as i from lineitem)
    select l_suppkey, begun + i as row, unnest([0, 1, 2])::int as col, unnest([x, y, z]) as value from p join o using (l_suppkey, l_orderkey)""")
def bubble_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"), F.col("l_tax").alias("size"))
    series = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("points"))
    return audits.bubble_cells(series, "l_suppkey", "l_orderkey", "points")


@query("""select l_orderkey, l_linenumber, coalesce(case when l_linenumber % 3 = 0 then '0.0' end, case when l_returnflag = 'R' then '0%' end, case when l_orderkey % 4 = 0 then '$0' end, 'General') as format, case when l_quantity > 25 then 'big' else 'small' end as iif, length(l_returnflag || l_linestatus)::int as len, l_linenumber::varchar as str, l_quantity * 1.5 as scaled from lineitem""")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number formats that points inherit, and calculated fields whose parameters are bound before they run."""
    parameters = {"limit": 25.0, "scale": 1.5}
    key, line, quantity = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    form = audits.inherited_format(F.when(line % 3 == 0, "0.0"), F.when(F.col("l_returnflag") == "R", "0%"), F.when(key % 4 == 0, "$0"))
    iif = F.when(quantity > F.lit(parameters["limit"]), "big").otherwise("small")
    return table(spark, sf_dir, "lineitem").select(key, line, form.alias("format"), iif.alias("iif"), F.length(F.concat("l_returnflag", "l_linestatus")).alias("len"), line.cast("string").alias("str"), (quantity * parameters["scale"]).alias("scaled"))


@query(f"""with e as ({ELEMENTS_SQL}) select element_id, md5(concat_ws('|', kind, round(x, 3)::double, round(w, 3)::double, left(label, 120))) <> '' as has_print, left(kind, 1) || '-' || case when length(label) > 20 then left(label, 19) || '…' else label end as digest, '{{"kind":"' || kind || '"' || case when z > 8 then ',"z":' || z else '' end || '}}' as json from e""")
def element_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest lines, prints for comparison, and JSON without what is null."""
    label = F.col("label")
    printed = F.md5(F.concat_ws("|", "kind", F.round("x", 3).cast("string"), F.round("w", 3).cast("string"), F.left(label, F.lit(120))))
    digest = F.concat(F.left("kind", F.lit(1)), F.lit("-"), text.shortened(label, 20))
    json = F.to_json(F.struct("kind", F.when(F.col("z") > 8, F.col("z")).alias("z")))
    return elements(spark, sf_dir).select("element_id", (printed != "").alias("has_print"), digest.alias("digest"), json.alias("json"))


@query(f"""with e as ({ELEMENTS_SQL}), v as (select distinct page, x::double as x from e), g as (select page, x, x - coalesce(lag(x) over (partition by page order by x), x) > 2 as jump from v), n as (select page, x, sum(jump::int) over (partition by page order by x) as col from g)
    select page, col::bigint as col, min(x)::double as x0, max(x)::double as x1, count(*) as starts from n group by 1, 2""")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.gap_columns(elements(spark, sf_dir), "page", "x", gap=2)
