"""Search, metrics, structure and coverage queries over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, relate, rollups, search, snapshots
from ..sources.files import table
from .registry import query

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_distinct([lower(w) for w in regexp_extract_all(coalesce(text, ''), '{text.IDENTIFIER}') if length(w) >= 2 and lower(w) not in ({STOP})])"
QUESTION = "data from the school and water in river"


def _bm25_sql(columns: str, rest: str) -> str:
    wanted = ", ".join(f"'{w}'" for w in search.query_tokens(QUESTION))
    return f"""with d as (select doc_id, {TOKENS} as tokens from documents),
        t as (select doc_id, len(tokens) as n, unnest([w for w in tokens if w in ({wanted})]) as w from d),
        df as (select w, count(*) as df from t group by 1), g as (select count(*) as docs, avg(len(tokens)) as mean from d),
        s as (select doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * greatest(n, 1) / mean))) as score from t join df using (w), g group by 1)
        select {columns} from s {rest}"""


@query(_bm25_sql("doc_id, round(score, 6) as score", ""))
def element_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), QUESTION).withColumn("score", F.round("score", 6))


IDENTIFIERS = """[x for x in list_distinct([lower(p) for p in flatten([list_concat([w], list_concat(string_split(w, '_'), string_split(w[1] || regexp_replace(w[2:], '([A-Z])', ' \\1', 'g'), ' ')))
    for w in regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_]*')])]) if length(x) >= 3]"""


@query(f"""with c as (select conv_id * 1000 + turn as chunk, {IDENTIFIERS} as t from conversations)
    select chunk, len([x for x in t if x in ('what', 'about', 'please', 'help', 'with')])::int as shared, round(len([x for x in t if x in ('what', 'about', 'please', 'help', 'with')]) / 5, 4) as score
    from c where shared > 0 order by shared desc, chunk limit 20""")
def keyword_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk"), "text")
    return search.retrieve(chunks, "please help with what about", top=20, id_col="chunk")


@query(rf"""with p as (select doc_id, trim(unnest(regexp_extract_all(coalesce(text, ''), '{text.LABEL_FIRST}', 1)), ' ') as label, trim(unnest(regexp_extract_all(coalesce(text, ''), '{text.LABEL_FIRST}', 2)), ' ') as value from documents
      union all select doc_id, trim(unnest(regexp_extract_all(coalesce(text, ''), '{text.VALUE_FIRST}', 2)), ' '), trim(unnest(regexp_extract_all(coalesce(text, ''), '{text.VALUE_FIRST}', 1)), ' ') from documents),
    n as (select doc_id, regexp_replace(regexp_replace(lower(label), '\s+', ' ', 'g'), '^[: .;,\-]+|[: .;,\-]+$', '', 'g') as metric, value, regexp_replace(value, '[,\s]', '', 'g') as bare, upper(right(value, 1)) as unit from p),
    v as (select *, try_cast(regexp_extract(bare, '^[$€£]?([-+]?[0-9]+(?:\.[0-9]+)?)[MmKkBb]?%?$', 1) as double)
             * case upper(regexp_extract(bare, '([MmKkBb])%?$', 1)) when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 else 1.0 end / case when ends_with(bare, '%') then 100 else 1 end as amount,
           case when unit = '%' then 'percentage' when regexp_matches(value, '^[$€£]') then case unit when 'M' then 'currency_million' when 'K' then 'currency_thousand' when 'B' then 'currency_billion' else 'currency' end
                when unit in ('M', 'K', 'B') then 'number_' || unit else 'number' end as format from n)
    select metric, count(*) as mentions, count(distinct doc_id) as documents, count(distinct amount) as amounts, count(distinct format) as formats from v group by 1 having count(*) >= 2 and (count(distinct amount) > 1 or count(distinct format) > 1)""")
def inconsistent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.inconsistent(metrics.extract(table(spark, sf_dir, "documents")))


@query("""with old as (select o_orderkey, o_orderstatus as status, o_totalprice as price, o_orderpriority as priority from orders where o_orderkey % 10 <> 3),
    new as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as status, case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as price, o_orderpriority as priority from orders where o_orderkey % 10 <> 4)
    select * from (select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed'
         when a.status is distinct from b.status or a.price is distinct from b.price or a.priority is distinct from b.priority then 'modified' end as change,
       case when a.o_orderkey is null or b.o_orderkey is null then '' else concat_ws(',', case when a.status is distinct from b.status then 'status' end, case when a.price is distinct from b.price then 'price' end) end as fields
      from old a full join new b using (o_orderkey)) where change is not null""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    after = orders.filter(key % 10 != 4).withColumns({"status": F.when(key % 7 == 0, "X").otherwise(F.col("status")), "price": F.when(key % 11 == 0, F.col("price") + 1).otherwise(F.col("price"))})
    return snapshots.diff(orders.filter(key % 10 != 3), after, ["o_orderkey"], ["status", "price", "priority"])


@query("""with n as (select c_custkey, case when c_custkey % 3 = 0 then 'NEW' end as c_mktsegment, null::double as c_acctbal from customer where c_custkey % 2 = 0 union all select c_custkey + 10000000, 'ADDED', 1.0 from customer where c_custkey % 100 = 0)
    select coalesce(n.c_custkey, o.c_custkey) as c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) as c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal from customer o full join n on o.c_custkey = n.c_custkey""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.col("c_custkey")
    new = old.filter(key % 2 == 0).select(key, F.when(key % 3 == 0, "NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    added = old.filter(key % 100 == 0).select((key + 10000000).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))
    return snapshots.upsert(old, new.unionByName(added), ["c_custkey"])


@query("""with k as (select l_orderkey, string_agg(distinct l_returnflag || l_linestatus, '|' order by l_returnflag || l_linestatus) as signature, count(*) as n_parts from lineitem group by 1)
    select signature, n_parts, count(*) as members, min(l_orderkey) as prototype from k group by 1, 2""")
def structure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return rollups.structure_groups(parts, "l_orderkey", "kind")


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n, min(c_custkey) as first from customer group by 1, 2)
    select c_nationkey, arg_max(c_mktsegment, (n, -first)) as mode from c group by 1""")
def first_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.mode_by(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")


@query("""select source, avg((lang = 'en')::int) > 0.5 as mostly_english, round(median(n_chars), 1) as median_chars, count(*) as n from documents group by 1""")
def style_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        rollups.majority(F.col("lang") == "en").alias("mostly_english"), F.bround(F.median("n_chars"), 1).alias("median_chars"), F.count("*").alias("n")
    )


@query("""with c as (select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 16)
    select p_brand, n, (row_number() over (order by n desc, p_brand))::int as rank, case when rank = 1 then 'primary' when rank <= 5 then 'accent' else 'neutral' end as role from c""")
def palette_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return rollups.ranked_roles(counts, "p_brand", "n", [(1, "primary"), (5, "accent")], "neutral", 16)


@query("""with f as (select source, doc_id is not null as doc_id, coalesce(text, '') <> '' as text, coalesce(lang, '') <> '' as lang from documents),
    u as (select source, unnest(['doc_id', 'text', 'lang']) as field, unnest([doc_id, text, lang]) as has from f)
    select source, field, count(*) filter (has) as filled, count(*) filter (not has) as missing from u group by 1, 2""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    return rollups.coverage(docs, "source", ["doc_id", "text", "lang"])


@query("""select source, field, n_values from (select source, unnest(['lang', 'text']) as field, unnest([count(distinct lang), count(distinct text)]) as n_values from documents group by 1) where n_values >= 2""")
def varying_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.varying(table(spark, sf_dir, "documents"), "source", ["lang", "text"])


@query("""select doc_id from documents where doc_id not in (select doc_id from labels)""")
def uncovered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.uncovered(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(r"""select doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: length(trim(x, ' ')) > 0))::bigint as chunks from documents where len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: length(trim(x, ' ')) > 0)) > 0""")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query(r"""select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(*) as pages, count(distinct regexp_extract(html, '<title>([^<]*)</title>', 1)) as titles, sum(len(regexp_extract_all(html, '<a\s')))::bigint as links from pages group by 1""")
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, title = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    links = F.sum(F.regexp_count("html", F.lit(r"<a\s")))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(title).alias("titles"), links.alias("links"))


@query("""select * from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as previous from conversations)
    where case when previous is null then role <> 'user' when previous = 'user' then role <> 'assistant' when previous = 'assistant' then role <> 'user' when previous = 'system' then role <> 'user' else true end""")
def bad_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    allowed = {"user": ["assistant"], "assistant": ["user"], "system": ["user"]}
    return snapshots.bad_transitions(turns, "conv_id", "role", [F.col("turn")], allowed, first="user")
