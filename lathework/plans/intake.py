"""Queries on intake of material, templates with typed inputs, cell rules, shares, dispatch and audit rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import materials, reshape, rollups, workspace
from ..sources.files import table
from .elements import ELEMENTS_SQL, elements
from .registry import query

#: Documents as uploads; every seventh has a line that assigns a password of its own.
UPLOADS_SQL = """select doc_id, case when doc_id % 2 = 0 then 'f.csv' else 'notes.md' end as name, coalesce(text, '') || case when doc_id % 7 = 3 then chr(10) || 'password = ''' || left(md5(doc_id::varchar), 12) || '''' else '' end as t from documents"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    planted = F.when(key % 7 == 3, F.concat(F.lit("\npassword = '"), F.left(F.md5(key.cast("string")), F.lit(12)), F.lit("'"))).otherwise("")
    return table(spark, sf_dir, "documents").select(key.alias("material_id"), F.when(key % 2 == 0, "f.csv").otherwise("notes.md").alias("filename"), F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))


@query(f"""with u as ({UPLOADS_SQL}), l as (select doc_id, string_split(case when ends_with(t, chr(10)) then t[1:-2] else t end, chr(10)) as lines from u where doc_id % 2 = 0 and t <> '' and doc_id % 7 <> 3),
    c as (select doc_id, 1 + len(list_filter(range(2, len(lines) + 1, 20), lambda i: trim(array_to_string(lines[i:i + 19], ''), ' ') <> '')) as n from l
      union all select doc_id, len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: length(trim(x, ' ')) > 0)) from u where doc_id % 2 = 1 and doc_id % 7 <> 3)
    select doc_id as material_id, doc_id % 7 = 3 as refused, (doc_id % 7 = 3)::int as n_findings, coalesce(n, 0)::bigint as chunks from u left join c using (doc_id)""")
def taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with a secret are refused; the others become chunks."""
    return materials.taken_in(uploads(spark, sf_dir))[0].drop("findings")


@query("""select p_partkey, case p_partkey % 4 when 0 then '[1,"' || p_brand || '"]' when 1 then p_size::varchar when 2 then '""' else '"' || p_brand || ' of ' || p_size || ' and [1,\\"' || p_brand || '\\"]!"' end as filled from part""")
def typed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that are one hole alone keep their input's type."""
    key = F.col("p_partkey")
    forms = F.get(F.array(*map(F.lit, ("{{list}}", " {{ size }} ", "{{nothing}}", "{{brand}} of {{size}}{{none}} and {{ list }}!"))), (key % 4).cast("int"))
    quoted = F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))
    inputs = F.create_map(F.lit("list"), F.concat(F.lit("[1,"), quoted, F.lit("]")), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), quoted)
    return table(spark, sf_dir, "part").select(key, text.typed_template(forms, inputs).alias("filled"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 5 = 0 then null when l_quantity >= 25 then 'red' else 'green' end as fill, case when l_partkey % 5 = 0 then null when l_tax = 0.04 then 'bold' end as font from lineitem""")
def cell_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of cells by rules on the numbers that their texts begin with."""
    shown = lambda c, unit: F.when(F.col("l_partkey") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.col(c).cast("string"), F.lit(unit)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.by_rule(shown("l_quantity", " pcs"), ">=", 25, "red", "green").alias("fill"), values.by_rule(shown("l_tax", ""), "=", 0.04, "bold", None).alias("font"))


@query("""with g as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2) select *, round(n / sum(n) over (partition by o_orderstatus), 6) as of_status, round(n / sum(n) over (), 6) as of_all from g""")
def order_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a group's and of the grand total."""
    counted = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    out = reshape.shares(reshape.shares(counted, "n", ["o_orderstatus"], "of_status"), "n", [], "of_all")
    return out.withColumns({c: F.round(c, 6) for c in ("of_status", "of_all")})


@query(f"""with e as ({ELEMENTS_SQL}) select page, count(*) as count, round(100.0::double * count(*) filter (z % 3 = 0) / count(*), 1)::double as banded, round(100.0::double * count(*) filter (w > 2) / count(*), 1)::double as wide from e where kind = 'table' group by 1""")
def table_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each page's tables are banded and wide, in per cent."""
    return rollups.percent_where(elements(spark, sf_dir).filter("kind = 'table'"), ["page"], {"banded": F.col("z") % 3 == 0, "wide": F.col("w") > 2})


@query("""select o_orderkey, case when o_orderkey % 3 <> 0 and o_orderdate <= timestamp '1996-01-01' then 'dispatched' else o_orderstatus end as status, (case when o_orderkey % 3 <> 0 and o_orderdate <= timestamp '1996-01-01' then timestamp '1996-01-02' else o_orderdate end)::timestamp as next_run from orders""")
def dispatched_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(key, (key % 3 != 0).alias("enabled"), F.col("o_orderdate").alias("next_run"), F.col("o_orderstatus").alias("status"))
    out = workspace.dispatched(jobs, F.lit("1996-01-01").cast("timestamp"), F.lit("1996-01-02").cast("timestamp"))
    return out.select(key, "status", F.col("next_run").cast("timestamp").alias("next_run"))


@query("""with r as (select event_id, case when event_type = 'view' then 'get' else 'POST' end as method, '/api/docs/' || user_id || ['/slides', '/export', '/undo-state', '/exported', '/bridge.png', '/bridgexpng'][(event_id % 6 + 1)::int] as path, [200, 201, 404, 500][(event_id % 4 + 1)::int] as status, event_id % 10 = 0 as handled from events)
    select event_id, case when status >= 400 then 'failed' else 'executed' end as result, case when status >= 400 then 'HTTP ' || status end as error from r where method = 'POST' and not handled and (status >= 500 or not (ends_with(path, '/export') or ends_with(path, '/undo-state') or ends_with(path, '/bridge.png')))""")
def recorded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests an audit log records."""
    key = F.col("event_id")
    ends = F.get(F.array(*map(F.lit, ("/slides", "/export", "/undo-state", "/exported", "/bridge.png", "/bridgexpng"))), (key % 6).cast("int"))
    status = F.get(F.array(*map(F.lit, (200, 201, 404, 500))), (key % 4).cast("int"))
    path = F.concat(F.lit("/api/docs/"), F.col("user_id").cast("string"), ends)
    requests = table(spark, sf_dir, "events").select(key, F.when(F.col("event_type") == "view", "get").otherwise("POST").alias("method"), path.alias("path"), status.alias("status"), (key % 10 == 0).alias("handled"))
    return workspace.recorded_requests(requests).select(key, "result", "error")


@query("""select event_id from events where event_type = 'click' and user_id = 7 and ts >= timestamp '2024-01-05'""")
def filtered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that are given hold together; those left empty don't count."""
    events = table(spark, sf_dir, "events")
    wishes = {"event_type": "click", "user_id": 7, "props": "", "event_id": None}
    return workspace.where_given(events, wishes, since=("ts", F.lit("2024-01-05").cast("timestamp")), until=("ts", None)).select("event_id")
