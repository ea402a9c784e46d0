"""Queries on chart types, styles, arguments, records and reports of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charts
from ..operators import audits, workspace
from ..sources.files import table
from .elements import ELEMENTS_SQL, elements
from .registry import query

PLOTS = ("area", "bar", "line", "pie", "doughnut", "radar", "scatter", "bubble")
GROUPINGS = ("standard", "stacked", "percentStacked", "clustered")


@query("""with p as (select p_partkey, ['area', 'bar', 'line', 'pie', 'doughnut', 'radar', 'scatter', 'bubble'][(p_partkey % 8 + 1)::int] as plot, ['standard', 'stacked', 'percentStacked', 'clustered'][(p_size % 4 + 1)::int] as g, p_size % 3 = 0 as lying, p_size % 2 = 0 as marks, p_size % 5 = 0 as flag,
      case when p_size % 3 = 0 then 'lineMarker' when p_size % 3 = 1 then 'smoothMarker' else 'filled' end as style from part),
    n as (select *, case g when 'stacked' then '_STACKED' when 'percentStacked' then '_STACKED_100' else '' end as tail from p)
    select p_partkey, case plot when 'area' then case when g <> 'clustered' then 'AREA' || tail end when 'bar' then case when g <> 'standard' then (case when lying then 'BAR' else 'COLUMN' end) || case when g = 'clustered' then '_CLUSTERED' else tail end end
      when 'line' then case when g <> 'clustered' then (case when marks then 'LINE_MARKERS' else 'LINE' end) || tail end when 'pie' then case when flag then 'PIE_EXPLODED' else 'PIE' end when 'doughnut' then case when flag then 'DOUGHNUT_EXPLODED' else 'DOUGHNUT' end
      when 'bubble' then case when flag then 'BUBBLE_THREE_D_EFFECT' else 'BUBBLE' end when 'radar' then case when style = 'filled' then 'RADAR_FILLED' when marks then 'RADAR_MARKERS' else 'RADAR' end
      else case when style = 'lineMarker' then case when not flag then 'XY_SCATTER' when marks then 'XY_SCATTER_LINES' else 'XY_SCATTER_LINES_NO_MARKERS' end when style = 'smoothMarker' then case when marks then 'XY_SCATTER_SMOOTH' else 'XY_SCATTER_SMOOTH_NO_MARKERS' end else 'XY_SCATTER' end end as chart_type from n""")
def chart_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    style = F.when(size % 3 == 0, "lineMarker").when(size % 3 == 1, "smoothMarker").otherwise("filled")
    flag = size % 5 == 0
    named = charts.chart_type(pick(PLOTS, key % 8), pick(GROUPINGS, size % 4), size % 3 == 0, size % 2 == 0, flag, style, flag, flag)
    return table(spark, sf_dir, "part").select(key, named.alias("chart_type"))


@query("""with a as (select p_partkey as tool, unnest(['zeta', 'alpha', 'mid', 'beta']) as name, unnest([p_partkey % 2 = 0, false, p_partkey % 3 = 0, true]) as required from part)
    select tool, name, (row_number() over (partition by tool order by required desc, name))::int as nth from a""")
def argument_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required arguments first, then by name."""
    key = F.col("p_partkey")
    argument = lambda name, required: F.struct(F.lit(name).alias("name"), required.alias("required"))
    listed = F.array(argument("zeta", key % 2 == 0), argument("alpha", F.lit(False)), argument("mid", key % 3 == 0), argument("beta", F.lit(True)))
    rows = table(spark, sf_dir, "part").select(key.alias("tool"), F.explode(listed).alias("x")).select("tool", "x.*")
    return rows.select("tool", "name", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("required"), "name")).alias("nth"))


@query("""with a as (select c_custkey, case when c_custkey % 2 = 0 then lower(replace(n_name, ' ', '-')) else replace(n_name, ' ', '-') end as wanted from customer join nation on c_nationkey = n_nationkey)
    select c_custkey, min(n_nationkey)::int as style from a join nation on upper(replace(n_name, ' ', '')) = upper(replace(wanted, '-', '')) group by 1""")
def styles_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles asked for in another case and with hyphens; the first that agrees."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.replace("n_name", F.lit(" "), F.lit("-"))
    asked = asked.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower(name)).otherwise(name).alias("wanted"))
    return asked.join(nations, charts.same_style(F.col("n_name"), F.col("wanted"))).groupBy("c_custkey").agg(F.min("n_nationkey").alias("style"))


@query("""select event_id, k + 1 as k, event_type as kind, '{"k":' || (k + 1) || ',"meta":{"kind":"' || event_type || '"}}' as body from (select *, (props::json->>'k')::bigint as k from events)""")
def changed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested records read and set by path."""
    record = F.from_json("props", "k long, meta struct<kind string>")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", record.alias("r"))
    rows = rows.withColumn("r", F.struct(F.col("r.k").alias("k"), F.struct(F.lit(None).cast("string").alias("kind")).alias("meta")))
    changed = charts.with_path(charts.with_path(F.col("r"), "k", F.col("r.k") + 1), "meta.kind", F.col("event_type"))
    return rows.select("event_id", changed.alias("c")).select("event_id", "c.k", "c.meta.kind", F.to_json("c").alias("body"))


@query(f"""with e as ({ELEMENTS_SQL}) select element_id from e where kind = 'shape' and w * h >= 1.0 and h > 0.3 and coalesce(case when z % 4 <> 0 then z / 16.0 end, 1) >= 0.05""")
def cell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rectangles that are no hairlines, large enough and not transparent."""
    w, h, z = F.col("w"), F.col("h"), F.col("z")
    opacity = F.when(z % 4 != 0, z / 16.0)
    kept = (F.col("kind") == "shape") & (w * h >= 1.0) & (h > 0.3) & (F.coalesce(opacity, F.lit(1.0)) >= 0.05)
    return elements(spark, sf_dir).filter(kept).select("element_id")


FIXES = {"empty": "drop empty documents", "long": "split long documents", "foreign": "detect languages"}


@query("""with g as (select unnest([case when coalesce(text, '') = '' then 'empty' end, case when n_chars > 9000 then 'long' end, case when lang <> 'en' then 'foreign' end]) as gap from documents), c as (select gap, count(*) as n, count(*) filter (gap = 'empty') as n_ok, count(*) filter (gap <> 'empty') as n_failed from g where gap is not null group by 1)
    select gap, n, case gap when 'empty' then 'drop empty documents' when 'long' then 'split long documents' else 'detect languages' end as fix from c""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each gap, and what to mend."""
    rules = {"empty": F.coalesce("text", F.lit("")) == "", "long": F.col("n_chars") > 9000, "foreign": F.col("lang") != "en"}
    counted = audits.tallied(workspace.gaps(table(spark, sf_dir, "documents"), "doc_id", rules), "gap", F.col("gap") == "empty")
    fix = F.create_map(*(F.lit(x) for pair in FIXES.items() for x in pair))[F.col("gap")]
    return counted.select("gap", "n", fix.alias("fix"))
