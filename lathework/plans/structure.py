"""Colour, cascade, graph, transform, routing and secret-finding queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colours, findings, prompts
from ..operators import graphs
from ..sources.files import table
from .registry import query


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("""with c as (select p_partkey, upper(md5(p_name)[1:6]) as h, p_size * 2000 / 100000 as m, case when p_partkey % 3 = 0 then 0.2 else 0 end as o, case when p_partkey % 5 = 0 then 0.75 else 1 end as sh,
        case when p_partkey % 7 = 0 then 0.4 else 1 end as ti, case when p_partkey % 11 = 0 then 0.5 else 1 end as al from part),
    v as (select *, ('0x' || h[1:2])::int / 255 as r, ('0x' || h[3:4])::int / 255 as g, ('0x' || h[5:6])::int / 255 as b from c),
    l as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo, (hi + lo) / 2 as light, case when hi = lo then 0 when light <= 0.5 then (hi - lo) / (hi + lo) else (hi - lo) / (2 - hi - lo) end as s, greatest(0, least(1, light * m + o)) as after from v),
    t as (select *, case when after <= 0.5 then after * (1 + s) else after + s - after * s end as m2, 2 * after - m2 as m1 from l),
    k as (select p_partkey, unnest(['r', 'g', 'b']) as c, unnest([case when hi = lo then after else m1 + (r - lo) / (hi - lo) * (m2 - m1) end, case when hi = lo then after else m1 + (g - lo) / (hi - lo) * (m2 - m1) end, case when hi = lo then after else m1 + (b - lo) / (hi - lo) * (m2 - m1) end]) as x, sh, ti, al from t),
    n as (select p_partkey, c, greatest(0, least(255, round_even(round(((1 - (1 - x * sh) * ti) * al + (1 - al)) * 255, 9), 0)))::int as n from k)
    select p_partkey, '#' || string_agg(printf('%02X', n), '' order by case c when 'r' then 1 when 'g' then 2 else 3 end) as colour from n group by 1""")
def modified_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, some = F.col("p_partkey"), lambda n, value: F.when(F.col("p_partkey") % n == 0, value)
    colour = F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))
    return table(spark, sf_dir, "part").select(key, colours.modified(colour, F.col("p_size") * 2000, some(3, 20000), some(5, 75000), some(7, 40000), some(11, 50000)).alias("colour"))


@query("""select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_orderpriority end, case when c_custkey % 2 = 0 then c_mktsegment end, case when n_nationkey % 5 = 0 then n_name end, 'PLAIN') as style,
      case when o_orderkey % 3 = 0 then 'own' when c_custkey % 2 = 0 then 'customer' when n_nationkey % 5 = 0 then 'nation' else 'default' end as origin
    from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    only = lambda key, n, value: F.when(F.col(key) % n == 0, F.col(value))
    style = graphs.cascaded({"own": only("o_orderkey", 3, "o_orderpriority"), "customer": only("c_custkey", 2, "c_mktsegment"), "nation": only("n_nationkey", 5, "n_name")}, "PLAIN")
    return rows.select("o_orderkey", style.alias("s")).select("o_orderkey", F.col("s.value").alias("style"), F.col("s.origin").alias("origin"))


@query("""select l_orderkey, l_linenumber, coalesce(case when l_linenumber % 3 = 0 then 'last' end, case when l_returnflag = 'R' then 'band' end, case when l_linenumber = 1 then 'header' end, 'whole') as fill from lineitem""")
def table_style_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    layers = [F.lit("whole"), F.when(line == 1, "header"), F.when(F.col("l_returnflag") == "R", "band"), F.when(line % 3 == 0, "last")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", graphs.overlaid(layers).alias("fill"))


@query("""with recursive e as (select c_custkey // 2 as source, c_custkey as target from customer where c_custkey % 7 <> 0 union all select c_custkey, 1 from customer where c_custkey % 50 = 0),
    r(node, depth) as (select 1::bigint, 0 union select target, depth + 1 from e join r on source = node where depth < 40 and target <> 1)
    select node, min(depth)::int as depth from r group by 1""")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over customers with some edges left out and some leading back to its root."""
    key = F.col("c_custkey")
    keys = table(spark, sf_dir, "customer").select(key)
    down = keys.filter(key % 7 != 0).select(F.floor(key / 2).cast("long").alias("source"), key.alias("target"))
    back = keys.filter(key % 50 == 0).select(key.alias("source"), F.lit(1).cast("long").alias("target"))
    return graphs.reachable(down.unionByName(back), spark.range(1, 2).select(F.col("id").alias("node")))


@query("""with r as (select 'r' || r_regionkey as id, r_regionkey * 10.0 as ox, r_regionkey * 5.0 as oy, 2.0 as sx, 0.5 as sy, r_regionkey from region),
    n as (select 'n' || n_nationkey as id, r.ox + r.sx * n_nationkey as ox, r.oy + r.sy * n_nationkey * 2 as oy, r.sx * 0.25 as sx, r.sy * 4.0 as sy, n_nationkey from nation join r on n_regionkey = r_regionkey),
    c as (select 'c' || c_custkey as id, n.ox + n.sx * (c_custkey % 16) as ox, n.oy + n.sy * 3.0 as oy, n.sx * 0.5 as sx, n.sy * 1.0 as sy from customer join n on c_nationkey = n_nationkey)
    select id, ox::double as off_x, oy::double as off_y, sx::double as scale_x, sy::double as scale_y from (select id, ox, oy, sx, sy from r union all select id, ox, oy, sx, sy from n union all select * from c)""")
def composed_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in groups: regions hold nations, nations hold customers."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))

    def groups(source: str, id_, parent, *numbers) -> DataFrame:
        values = [x.cast("double").alias(c) for x, c in zip(numbers, ("off_x", "off_y", "scale_x", "scale_y"), strict=True)]
        return table(spark, sf_dir, source).select(id_.alias("id"), parent.alias("parent"), *values)

    region, nation, customer = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    everything = groups("region", name("r", "r_regionkey"), F.lit(None).cast("string"), region * 10, region * 5, F.lit(2), F.lit(0.5))
    everything = everything.unionByName(groups("nation", name("n", "n_nationkey"), name("r", "n_regionkey"), nation, nation * 2, F.lit(0.25), F.lit(4)))
    everything = everything.unionByName(groups("customer", name("c", "c_custkey"), name("n", "c_nationkey"), customer % 16, F.lit(3), F.lit(0.5), F.lit(1)))
    return graphs.composed(everything)


def _routed_sql() -> str:
    hits = {m: " + ".join(f"regexp_matches(t, {_quoted(p)})::int" for p in patterns) for m, patterns in prompts.SIGNALS.items()}
    return f"""with h as (select conv_id, turn, lower(coalesce(text, '')) as t, {hits["scripted_plan"]} as s, {hits["iterative_plan"]} as i, {hits["static_plan"]} as a from conversations)
        select conv_id, turn, case when s > 0 then 'scripted_plan' when i > 0 and a = 0 then 'iterative_plan' when a > 0 and i = 0 then 'static_plan' else 'iterative_plan' end as mode,
          round(case when s > 0 then least(0.9, 0.6 + 0.1 * s) when i > 0 and a = 0 then least(0.85, 0.5 + 0.1 * i) when a > 0 and i = 0 then least(0.8, 0.5 + 0.1 * a) else 0.4 end, 2)::double as confidence from h"""


@query(_routed_sql())
def routed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.routed(F.col("text")).alias("r"))
    return rows.select("conv_id", "turn", "r.mode", "r.confidence")


def _findings_sql() -> str:
    found, clean = [], "coalesce(text, '')"
    for kind, pattern in findings.PATTERNS.items():
        p, needed = _quoted(pattern), findings.PATTERNS.get(findings.ONLY_WITH.get(kind))
        wanted = f"regexp_matches(text, {p})" + (f" and regexp_matches(text, {_quoted(needed)})" if needed else "")
        found.append(f"select doc_id, len(regexp_extract_all(text, {p}))::bigint as n, (len(regexp_split_to_array(regexp_split_to_array(text, {p})[1], chr(10))))::int as line from documents where {wanted}")
        replaced = f"regexp_replace({clean}, {p}, '[REDACTED-{kind}]', 'g')"
        clean = f"case when regexp_matches(coalesce(text, ''), {_quoted(needed)}) then {replaced} else {clean} end" if needed else replaced
    return f"""with f as (select doc_id, sum(n)::bigint as n, min(line)::int as first_line from ({" union all ".join(found)}) group by 1)
        select doc_id, coalesce(n, 0)::bigint as findings, first_line, md5({clean}) as clean_md5 from documents left join f using (doc_id)"""


@query(_findings_sql())
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", "text", findings.lines(F.col("text")).alias("lines"))
    return found.select("doc_id", F.size("lines").cast("long").alias("findings"), F.array_min("lines").alias("first_line"), F.md5(findings.redacted(F.col("text"))).alias("clean_md5"))


#: Strings with the shape of secrets, made of ids, behind each text; their beginnings are put together so that none stands here.
PLANTED_SQL = """chr(10) || ' Password = "' || left(md5(doc_id::varchar), 12) || '"' || chr(10) || 'key AKI' || 'A' || upper(left(md5(doc_id::varchar), 16)) || ' and ' || sha1(doc_id::varchar) || chr(10) || repeat('gh' || 'p_' || md5(doc_id::varchar) || '0000 ', (doc_id % 4)::int)"""


def with_planted(text, key) -> Column:
    digest = F.md5(key.cast("string"))
    line = lambda *parts: F.concat(F.lit("\n"), *parts)
    pat = F.concat(F.lit("gh"), F.lit("p_"), digest, F.lit("0000 "))
    return F.concat(text, line(F.lit(' Password = "'), F.left(digest, F.lit(12)), F.lit('"')), line(F.lit("key AKI"), F.lit("A"), F.upper(F.left(digest, F.lit(16))), F.lit(" and "), F.sha1(key.cast("string"))), line(F.repeat(pat, (key % 4).cast("int"))))


def _excerpts_sql() -> str:
    parts = []
    for kind, pattern in findings.PATTERNS.items():
        p, needed = _quoted(pattern), findings.PATTERNS.get(findings.ONLY_WITH.get(kind))
        wanted = f"regexp_matches(t, {p})" + (f" and regexp_matches(t, {_quoted(needed)})" if needed else "")
        parts.append(f"select doc_id, t, '{kind}' as kind, regexp_split_to_array(t, {p}) as gaps, regexp_extract_all(t, {p}) as secrets from d where {wanted}")
    return f"""with d as (select doc_id, coalesce(text, '') || {PLANTED_SQL} as t from documents), m as ({" union all ".join(parts)}), e as (select *, unnest(range(1, len(secrets) + 1)) as i from m),
        l as (select doc_id, t, kind, secrets[i] as secret, len(string_split(array_to_string(gaps[1:i], '') || array_to_string(secrets[1:i - 1], ''), chr(10)))::int as line from e)
        select doc_id, kind, line, left(replace(string_split(t, chr(10))[line], secret, '[REDACTED-' || length(secret) || ']'), 200) as excerpt from l"""


@query(_excerpts_sql())
def secret_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each secret's kind, line and masked excerpt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    return findings.findings(docs)
