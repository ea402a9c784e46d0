"""Queries on lists of a workspace: orders stand for jobs and changes, customers for people, parts for templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases, text
from ..operators import rollups, similarity, snapshots, workspace
from ..sources.files import table
from .registry import query


@query("""select c_custkey from customer where ((c_nationkey % 5 = 3 and (c_mktsegment in ('BUILDING', 'MACHINERY') or c_custkey % 10 = 7)) or c_custkey % 97 = 0) and c_name ilike '%CUSTOMER%0%' order by (c_custkey % 97 = 0) desc, c_name, c_custkey limit 20 offset 2""")
def visible_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key, "c_name", (F.col("c_nationkey") % 5).alias("org"), F.col("c_mktsegment").alias("scope"), (key % 10).alias("owner"), (key % 97 == 0).alias("builtin"))
    shown = workspace.visible(rows, 3, ["BUILDING", "MACHINERY"], 7).filter(F.col("c_name").ilike("%CUSTOMER%0%"))
    return workspace.page(shown, [F.desc("builtin"), "c_name", "c_custkey"], 20, 2).select("c_custkey")


@query("""select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 and o_orderdate <= timestamp '1996-01-01'""")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(key, "o_custkey", (key % 3 != 0).alias("enabled"), F.when(key % 5 != 0, F.col("o_orderdate")).alias("next_run"))
    found = workspace.due(jobs, F.lit("1996-01-01").cast("timestamp"))
    return found.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""select c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, min(o_orderdate) as o_orderdate from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F' group by 1""")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"))
    return workspace.first_of(rows, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])


@query("""with c as (select o_orderkey, 'F' as s from orders where o_orderkey % 4 = 1) select o_orderkey, case when o_orderstatus = 'O' and s is not null then s else o_orderstatus end as o_orderstatus from orders left join c using (o_orderkey) where not (o_orderkey % 9 = 2 and o_orderpriority <> '1-URGENT')""")
def guarded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = orders.filter("o_orderkey % 4 = 1").select("o_orderkey", F.lit("F").alias("o_orderstatus"))
    after = workspace.changed_where(orders, changes, "o_orderkey", "o_orderstatus", "O")
    return workspace.without(after, orders.filter("o_orderkey % 9 = 2"), "o_orderkey", F.col("o_orderpriority") == "1-URGENT").drop("o_orderpriority")


@query("""with s as (select p_partkey, case when p_partkey % 11 = 0 then p_size / 50 else 0 end as score, p_partkey in (5, 70) as pin, p_partkey % 13 = 1 as fb from part),
    w as (select *, case when pin then 'pinned' when score > 0 then 'scored' when fb then 'fallback' end as why, case when pin then 0 when score > 0 then 1 else 2 end as r from s)
    select p_partkey, why from w where why is not null order by r, case when r = 1 then -score else 0 end, p_partkey limit 25""")
def pinned_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key, F.when(key % 11 == 0, F.col("p_size") / 50).otherwise(0.0).alias("score"))
    return workspace.pinned_top(rows, "score", key.isin(5, 70), key % 13 == 1, ["p_partkey"], 25).select("p_partkey", "why")


@query("""with a as (select c_nationkey, c_mktsegment as name from customer group by 1, 2), b as (select s_nationkey, ['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE'][(s_suppkey % 5 + 1)::int] as name from supplier group by 1, 2),
    j as (select c_nationkey, s_nationkey, count(*) as shared from a join b using (name) group by 1, 2)
    select c_nationkey, s_nationkey, shared, (row_number() over (partition by c_nationkey order by shared desc, s_nationkey))::int as nth from j""")
def overlapping_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE")))
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("names"))
    b = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_set(F.get(names, (F.col("s_suppkey") % 5).cast("int"))).alias("names"))
    return workspace.overlapping(a, "c_nationkey", "names", b, "s_nationkey", "names")


PAIR_TOKENS = "list_distinct([lower(w) for w in regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_]+')])"


@query(f"""with d as (select doc_id as id, list_sort(list_filter({PAIR_TOKENS}, lambda w: not list_contains([{", ".join(f"'{w}'" for w in text.STOP_WORDS)}], w))) as t from documents),
    r as (select *, min(id) over (partition by t) as least from d where len(t) > 0), s as (select id, t from r where id = least),
    e as (select id, unnest(t) as w from s), p as (select a.id as a, b.id as b, count(*) as shared from e a join e b using (w) where a.id < b.id group by 1, 2)
    select a, b, shared::int as shared, round(shared / (len(x.t) + len(y.t) - shared), 6) as similarity from p join s x on x.id = a join s y on y.id = b where shared / (len(x.t) + len(y.t) - shared) >= 0.2
    union all select least, id, len(t)::int, 1.0 from r where id <> least""")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the first documents with each set of words; further documents with a set come once, with its first one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", text.search_tokens(F.col("text")).alias("tokens"))
    return similarity.similar_pairs(docs, "id", "tokens", 0.2, copies=False, kind="lang").withColumn("similarity", F.round("similarity", 6))


@query("""with o as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth from orders), e as (select user_id as k, event_id, row_number() over (partition by user_id order by ts, event_id) as nth from events)
    select k, nth::int as nth, o_orderkey, event_id from o join e using (k, nth)""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", "ts")
    return workspace.zipped(orders, events, "k", ["o_orderdate", "o_orderkey"], ["ts", "event_id"]).select("k", "nth", "o_orderkey", "event_id")


@query("""with u as (select o_custkey, count(*) as n, list('rId' || case when o_orderkey % 3 = 0 then o_orderkey else i end) as names from (select *, row_number() over (partition by o_custkey order by o_orderkey) + 1 as i from orders) group by 1)
    select o_custkey, (select max(x) from unnest(range(1, n + 2)) r(x) where not list_contains(names, 'rId' || x)) as next from u""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1
    used = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("rId"), F.when(key % 3 == 0, key).otherwise(nth).cast("string")).alias("name"))
    return workspace.free_number(used, "o_custkey", "name", "rId")


@query("""with t as (select p_partkey, 'Dear {{who}}, {{ what }} of {{size}} {{none}}.' as body from part),
    s as (select p_partkey, unnest(['who', 'what', 'size', 'note']) as name, unnest([true, p_partkey % 4 <> 0, false, false]) as required, unnest([null, case when p_partkey % 3 = 0 then 'goods' end, '0', null]) as def from t),
    i as (select p_partkey, name, case name when 'who' then p_brand when 'what' then p_type else p_size::varchar end as value from part join s using (p_partkey) where (name = 'who' and p_partkey % 5 <> 0) or (name = 'what' and p_partkey % 2 = 0) or (name = 'size' and p_partkey % 7 = 0)),
    j as (select p_partkey, name, required, coalesce(value, def) as v from s left join i using (p_partkey, name)),
    m as (select p_partkey, coalesce(string_agg(name, ',' order by name) filter (required and v is null), '') as missing, max(v) filter (name = 'who') as who, max(v) filter (name = 'what') as what, max(v) filter (name = 'size') as size from j group by 1)
    select p_partkey, missing, case when missing = '' then 'Dear ' || coalesce(who, '') || ', ' || coalesce(what, '') || ' of ' || coalesce(size, '') || ' .' end as body from m""")
def materialised_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    templates = parts.select(key, F.lit("Dear {{who}}, {{ what }} of {{size}} {{none}}.").alias("body"))
    entry = lambda name, required, default: F.struct(F.lit(name).alias("name"), required.alias("required"), default.cast("string").alias("default"))
    no, none = F.lit(False), F.lit(None)
    schema = parts.select(key, F.explode(F.array(entry("who", F.lit(True), none), entry("what", key % 4 != 0, F.when(key % 3 == 0, "goods")), entry("size", no, F.lit("0")), entry("note", no, none))).alias("x")).select("p_partkey", "x.*")
    given = lambda name, when, value: F.when(when, F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))
    inputs = parts.select(key, F.explode(F.array_compact(F.array(given("who", key % 5 != 0, F.col("p_brand")), given("what", key % 2 == 0, F.col("p_type")), given("size", key % 7 == 0, F.col("p_size"))))).alias("x")).select("p_partkey", "x.*")
    filled = workspace.filled_inputs(templates, schema, inputs, "p_partkey")
    body = F.when(F.size("missing") == 0, workspace.materialised(F.col("body"), F.col("inputs")))
    return filled.select("p_partkey", F.array_join("missing", ",").alias("missing"), body.alias("body"))


@query("""with w as (select p_partkey, [x for x in list_distinct([lower(t) for t in regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z][A-Za-z0-9_]*')]) if x in ('small', 'brass', 'widget', 'steel')] as s from part)
    select p_partkey, len(s)::int as shared from w where len(s) > 0 order by shared desc, p_partkey limit 15""")
def found_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return workspace.template_search(parts, "a small brass Widget of Steel", "p_partkey", "text", top=15)


@query("""with w as (select p_partkey, p_name as name, (p_size % 6)::bigint as i, p_partkey % 17 = 0 as keep from part), n as (select name, min(p_partkey) as first from w where not keep group by 1), d as (select i, min(p_partkey) as first from w where not keep and i > 0 group by 1)
    select p_partkey from w left join n using (name) left join d using (i) where keep or not (coalesce(n.first < p_partkey, false) or coalesce(d.first < p_partkey, false))""")
def wants_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, i = F.col("p_partkey"), (F.col("p_size") % 6).cast("long")
    wants = table(spark, sf_dir, "part").select(key, "p_name", F.when(i > 0, F.array(i, i + 1)).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    return workspace.once_each(wants, "p_partkey", F.lower("p_name"), F.col("ids"), key % 17 == 0).select("p_partkey")


@query("""select doc_id, gap from (select doc_id, unnest([case when coalesce(text, '') = '' then 'empty' end, case when n_chars < 200 then 'short' end, case when lang <> 'en' then 'language' end, case when regexp_matches(text, '(\\n[^\\n]*){40}') then 'many lines' end]) as gap from documents) where gap is not null""")
def document_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"empty": F.coalesce("text", F.lit("")) == "", "short": F.col("n_chars") < 200, "language": F.col("lang") != "en", "many lines": F.regexp_count("text", F.lit("\n")) >= 40}
    return workspace.gaps(table(spark, sf_dir, "documents"), "doc_id", rules)


@query("""select event_id, user_id, (sum(case when event_type in ('signup', 'view') then 1 else -1 end) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as open from events""")
def open_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(-1).alias("change"))
    return workspace.over_time(changes, "user_id", "ts", "change", ["event_id"]).select("event_id", "user_id", "open")


@query("""select event_id, k, violations from (select event_id, user_id % 3 as k, count(*) over (partition by user_id % 3 order by floor(epoch(ts))::bigint range between 3600 preceding and current row) as violations from events) where violations >= 5""")
def connection_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("k"), F.unix_timestamp("ts").alias("at"))
    return workspace.violators(events, "k", "at", seconds=3600, least=5).select("event_id", "k", "violations")


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) where n <= 3""")
def kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.kept_versions(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("""with p as (select event_id, case event_type when 'view' then 'GET' when 'error' then 'DELETE' else 'POST' end as m, '/api/docs/' || user_id || '/slides/' || event_id % 7 || case event_id % 5 when 0 then '/elements/chart' when 1 then '/script/run' when 2 then '/elements/e1/duplicate' when 3 then '/templates/t/apply' else '/regenerate' end as path from events)
    select event_id, case when ends_with(path, '/apply') then 'apply_template' when ends_with(path, '/regenerate') then 'regenerate' when ends_with(path, '/script/run') then 'code' when contains(path, '/elements/') and m = 'POST' and not ends_with(path, '/duplicate') then 'create' when m = 'DELETE' then 'delete' else 'edit' end as kind, regexp_extract(path, '/docs/([^/]+)', 1) as doc, nullif(regexp_extract(path, '/elements/([^/]+)', 1), '') as element from p""")
def logged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    ends = F.get(F.array(*map(F.lit, ("/elements/chart", "/script/run", "/elements/e1/duplicate", "/templates/t/apply", "/regenerate"))), (key % 5).cast("int"))
    path = F.concat(F.lit("/api/docs/"), F.col("user_id").cast("string"), F.lit("/slides/"), (key % 7).cast("string"), ends)
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "error", "DELETE").otherwise("POST")
    return table(spark, sf_dir, "events").select(key, phrases.action_kind(method, path).alias("kind"), phrases.path_part(path, "docs").alias("doc"), phrases.path_part(path, "elements").alias("element"))


@query("""with c as (select l_orderkey, count(*) as changes, count(*) filter (l_returnflag = 'A') as added, count(*) filter (l_returnflag = 'N') as modified, count(*) filter (l_returnflag = 'R') as removed from lineitem group by 1)
    select l_orderkey, case when added + modified + removed = 0 then 'No changes.' else concat_ws(', ', case when added > 0 then added || ' element' || case when added > 1 then 's' else '' end || ' added' end, case when modified > 0 then modified || ' element' || case when modified > 1 then 's' else '' end || ' modified' end, case when removed > 0 then removed || ' element' || case when removed > 1 then 's' else '' end || ' removed' end) || '.' end as summary from c""")
def change_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "N", "modified").when(F.col("l_returnflag") == "R", "removed")
    return snapshots.summaries(table(spark, sf_dir, "lineitem").select("l_orderkey", change.alias("change")), "l_orderkey", "change", "element")


@query("""with f as (select c_nationkey, c_mktsegment as v, min(c_custkey) as seen from customer group by 1, 2) select c_nationkey, array_to_string(list(v order by seen), ',') as values from f group by 1 having count(*) >= 2""")
def first_seen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.first_values(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return out.select("c_nationkey", F.array_join("values", ",").alias("values"))


@query("""select source, max(len(regexp_extract_all(text, '[^ ]+')))::int as n_words from documents where text is not null group by 1""")
def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("source", "doc_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("words"))
    return rollups.longest(docs, "source", "words", "doc_id").select("source", F.size("longest").alias("n_words"))
