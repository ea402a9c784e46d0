"""Queries over elements on pages: search options, positions, clusters, twins, brands. The parts stand for elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout, phrases, values
from ..functions.text import STOP_WORDS
from ..operators import brands, clusters, geometry, search
from ..sources.files import table
from .registry import query

KINDS = ("text", "shape", "chart", "table", "image")
#: Parts as elements of 40 pages of 13.333 by 7.5 inches.
ELEMENTS_SQL = """select p_partkey as element_id, (1 + p_partkey % 40)::int as page, ['text', 'shape', 'chart', 'table', 'image'][(1 + p_partkey % 5)::int] as kind, p_name || ' ' || p_type as label,
    (p_size % 10) * 1.25 as x, (p_partkey % 6) * 1.25 as y, 0.5 + (p_partkey % 7) * 0.5 as w, 0.25 + (p_size % 4) * 0.5 as h, (p_partkey % 17)::int as z, '#' || upper(md5(p_brand)[1:6]) as colour, p_brand as font from part"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.get(F.array(*map(F.lit, KINDS)), (key % 5).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("element_id"), (1 + key % 40).cast("int").alias("page"), kind.alias("kind"), F.concat_ws(" ", "p_name", "p_type").alias("label"), ((size % 10) * 1.25).alias("x"), ((key % 6) * 1.25).alias("y"),
        (0.5 + (key % 7) * 0.5).alias("w"), (0.25 + (size % 4) * 0.5).alias("h"), (key % 17).cast("int").alias("z"), F.concat(F.lit("#"), F.upper(F.substring(F.md5("p_brand"), 1, 6))).alias("colour"), F.col("p_brand").alias("font"),
    )


PLACE_SQL = """case when row = 'middle' and col = 'center' then 'center' else row || '-' || col end"""
REQUEST = "the big chart at the top left"


@query(f"""with e as ({ELEMENTS_SQL}),
    q as (select *, case when y + h / 2 < 7.5 / 3 then 'top' when y + h / 2 > 7.5 * 2 / 3 then 'bottom' else 'middle' end as row, case when x + w / 2 < 13.333 / 3 then 'left' when x + w / 2 > 13.333 * 2 / 3 then 'right' else 'center' end as col from e where page between 3 and 9 and kind in ('chart', 'table', 'text')),
    r as (select element_id, page, z, (case when kind = 'chart' then 1.0 else 0 end) + (case when page = 5 then 1.0 when abs(page - 5) = 1 then 0.3 else 0 end) + (case when {PLACE_SQL} in ('top-left', 'top-center', 'middle-left') then 0.5 else 0 end) as raw from q),
    s as (select *, raw / greatest(max(raw) over (), 1.5) as score from r where raw > 0),
    k as (select element_id, page, score from s where score >= 0.2 order by score desc, z desc, page, element_id limit 12)
    select element_id, page, round(score, 6)::double as confidence, (row_number() over o) = 1 and coalesce(score - lead(score) over o < 0.1, false) as ambiguous from k window o as (order by score desc, page, element_id)""")
def found_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = elements(spark, sf_dir).withColumn("place", values.quadrant(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    out = search.ranked_elements(placed, REQUEST, viewing=5, pages=(3, 9), kinds=["chart", "table", "text"], least=0.2, top=12)
    return out.select("element_id", "page", F.round("confidence", 6).alias("confidence"), "ambiguous")


SAID = "the polished brass widget chart"


def _said_sql() -> str:
    wanted = ", ".join(f"'{w}'" for w in search.query_tokens(SAID))
    tokens = f"list_distinct([lower(w) for w in regexp_extract_all(label, '[A-Za-z][A-Za-z0-9_]+') if lower(w) not in ({', '.join(repr(w) for w in STOP_WORDS)})])"
    return f"""with e as ({ELEMENTS_SQL}), d as (select element_id, page, kind, z, {tokens} as tokens from e), t as (select element_id, len(tokens) as n, unnest([w for w in tokens if w in ({wanted})]) as w from d),
        df as (select w, count(*) as df from t group by 1), g as (select count(*) as docs, avg(len(tokens)) as mean from d),
        b as (select element_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * greatest(n, 1) / mean))) as said from t join df using (w), g group by 1),
        r as (select element_id, page, z, coalesce(said, 0) + (case when kind = 'chart' then 1.0 else 0 end) + (case when page = 5 then 1.0 when abs(page - 5) = 1 then 0.3 else 0 end) as raw from d left join b using (element_id)),
        s as (select *, raw / greatest(max(raw) over (), 1.5) as score from r where raw > 0), k as (select element_id, page, score from s where score >= 0.2 order by round(score, 9) desc, z desc, page, element_id limit 12)
        select element_id, page, round(score, 6)::double as confidence from k"""


@query(_said_sql())
def elements_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that a request means by what they say, besides kind and page."""
    placed = elements(spark, sf_dir).withColumn("place", values.quadrant(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    out = search.ranked_elements(placed, SAID, viewing=5, least=0.2, top=12, text_col="label")
    return out.select("element_id", "page", F.round("confidence", 6).alias("confidence"))


def _words_sql(groups: dict[str, list[str]], test: str) -> str:
    return "[x for x in [" + ", ".join(f"case when {test.format('|'.join(words))} then '{name}' end" for name, words in groups.items()) + "] if x is not null]"


@query(f"""select conv_id, turn, array_to_string({_words_sql(phrases.TYPE_WORDS, r"regexp_matches(lower(coalesce(text, '')), '\b(?:{}})\b')".replace("{}}", "{}"))}, ',') as types,
      array_to_string({_words_sql(phrases.PLACE_WORDS, "regexp_matches(lower(coalesce(text, '')), '{}')")}, ',') as places, coalesce(lower(trim(text, ' ')) in ('this', 'it', 'that', 'selected', 'current'), false) as pronoun from conversations""")
def request_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ",")
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(phrases.named_types(text)).alias("types"), joined(phrases.named_places(text)).alias("places"), phrases.is_pronoun(text).alias("pronoun"))


@query(f"""with e as ({ELEMENTS_SQL}), a as (select element_id, x, y, w, h, w / h as r, length(label) * (1 + element_id % 9) as n, 12.0 + element_id % 30 as size from e),
    f as (select *, greatest(1, floor(w * 144 / size)) * greatest(1, floor(h * 72 / (size * 1.15))) as room, greatest(8.0, least(size, sqrt(w * h * (144 * 72 / 1.15) / greatest(1, n)))) as shrunk from a)
    select element_id, case when abs(r - 1) < 0.05 then 'square' when abs(r - 16.0 / 9) < 0.05 then 'landscape_16_9' when abs(r - 4.0 / 3) < 0.05 then 'landscape_4_3' when abs(r - 9.0 / 16) < 0.05 then 'portrait_9_16' when abs(r - 0.8) < 0.05 then 'portrait_4_5' when r > 1 then 'landscape_16_9' else 'portrait_9_16' end as aspect,
      round(100 * x / 13.333, 3)::double as left_pct, round(x * (10 / 13.333), 4)::double as stretched, round(x * least(10 / 13.333, 7.5 / 7.5) + (10 - 13.333 * least(10 / 13.333, 7.5 / 7.5)) / 2, 4)::double as fitted,
      (w * 914400)::bigint as width_emu, (case when n > room * 1.1 and shrunk < size * 0.95 then round(shrunk, 1) else size end)::double as font, (n / 4)::double as tokens from f""")
def element_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    n, size = F.length("label") * (1 + F.col("element_id") % 9), (12.0 + F.col("element_id") % 30).cast("double")
    page, target = (F.lit(13.333), F.lit(7.5)), (10, 7.5)
    return elements(spark, sf_dir).select(
        "element_id", layout.aspect(w, h).alias("aspect"), layout.percent_of(x, page[0]).alias("left_pct"), layout.moved([x, y, w, h], page, target)[0].alias("stretched"), layout.moved([x, y, w, h], page, target, "preserve_aspect_fit")[0].alias("fitted"),
        layout.emu(w, "inches").alias("width_emu"), layout.fitted_font(size, n, w, h).alias("font"), (n / 4).alias("tokens"),
    )


@query(f"""with e as ({ELEMENTS_SQL}) select page, min(x)::double as x0, min(y)::double as y0, max(x + w)::double as x1, max(y + h)::double as y1, count(*) as members, count(*) filter (kind = 'chart') as charts, count(*) filter (kind = 'text') as texts from e group by 1""")
def group_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.bounds(elements(spark, sf_dir), "page", {"charts": F.col("kind") == "chart", "texts": F.col("kind") == "text"})


@query(f"""with e as ({ELEMENTS_SQL}), p as (select page, string_agg(kind, '|' order by kind) as signature, count(*) as n from e where w >= 1 group by 1)
    select signature, count(*) as members, min(page)::int as prototype, round(least(1, count(*) / 8), 6)::double as confidence from p where n between 2 and 400 group by 1 having count(*) >= 2 order by members desc, prototype limit 25""")
def page_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the same multiset of kinds among elements at least an inch wide."""
    out = clusters.multiset_groups(elements(spark, sf_dir).filter("w >= 1"), "page", "kind", sizes=(2, 400), least=2)
    return clusters.candidates(out, whole=8, top=25)


@query(f"""with e as ({ELEMENTS_SQL}), s as (select page, string_agg(kind || '@' || round_even(x / 0.5, 0)::int || ',' || round_even(y / 0.5, 0)::int || '#' || round_even(w / 0.5, 0)::int || 'x' || round_even(h / 0.5, 0)::int, '|' order by kind, round_even(x / 0.5, 0), round_even(y / 0.5, 0), round_even(w / 0.5, 0), round_even(h / 0.5, 0)) as skeleton, min(font) as font, min(colour) as colour, count(*) as n from e group by page)
    select skeleton, count(*) as members, min(page)::int as first, ((count(distinct font) > 1)::int + (count(distinct colour) > 1)::int + (count(distinct n) > 1)::int)::int as axes from s group by 1""")
def structural_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind and place on a half-inch grid, and in how many ways their looks vary."""
    return clusters.twins(elements(spark, sf_dir), "page", "kind", ["x", "y", "w", "h"], {"font": F.min("font"), "colour": F.min("colour"), "n": F.count("*")}, axes=(0, 12))


@query(f"""with recursive e as ({ELEMENTS_SQL}), v as (select page, x::double as v, row_number() over (partition by page order by x) as i from e group by page, x),
    r(page, i, v, low) as (select page, i, v, v from v where i = 1 union all select v.page, v.i, v.v, case when v.v - r.low <= 1.5 then r.low else v.v end from r join v on v.page = r.page and v.i = r.i + 1)
    select page, v as x, low as snapped from r""")
def snapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.snapped(elements(spark, sf_dir), ["page"], "x", tolerance=1.5)


@query(f"""with recursive e as ({ELEMENTS_SQL}), b as (select element_id, page, x, y, x + 0.2 as x1, y + 0.2 as y1 from e),
    l as (select a.element_id as a, b.element_id as b from b a join b b on a.page = b.page and a.x - 0.3 < b.x1 and b.x - 0.3 < a.x1 and a.y - 0.3 < b.y1 and b.y - 0.3 < a.y1),
    c(id, low) as (select element_id, element_id from b union select l.b, c.low from c join l on l.a = c.id)
    select id as element_id, min(low) as cluster from c group by 1""")
def near_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    boxes = elements(spark, sf_dir).select(F.col("element_id").alias("box_id"), "page", x.alias("x0"), y.alias("y0"), (x + 0.2).alias("x1"), (y + 0.2).alias("y1"))
    return geometry.near_boxes(boxes, ["page"], proximity=0.3).select(F.col("box_id").alias("element_id"), "cluster")


@query(f"""with e as ({ELEMENTS_SQL}), g as (select page, count(distinct x) as columns, count(distinct y) as rows, count(distinct (x, y)) as cells from e group by 1),
    s as (select page, x, max(w) - min(w) as spread from e group by 1, 2), c as (select page, max(spread) <= 10 as even from s group by 1)
    select page, columns, rows, cells, round(cells / (columns * rows), 6) as fill, columns >= 2 and rows >= 2 and cells >= 0.65 * columns * rows and even as is_table from g join c using (page)""")
def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.grids(elements(spark, sf_dir), "page").withColumn("fill", F.round("fill", 6))


PALETTE = ("#3B82F6", "#10B981", "#C04020", "#205080", "#E0E0A0", "#702090")


def _distance_sql(a: str, b: str) -> str:
    return "sqrt((" + " + ".join(f"pow((('0x' || {a}[{i}:{i + 1}])::int - ('0x' || {b}[{i}:{i + 1}])::int) / 255.0, 2)" for i in (2, 4, 6)) + ") / 3)"


@query(f"""with e as ({ELEMENTS_SQL}), p(entry) as (values {", ".join(f"('{c}')" for c in PALETTE)}), c as (select distinct colour from e),
    n as (select colour, arg_min(entry, ({_distance_sql("colour", "entry")}, entry)) as entry, min({_distance_sql("colour", "entry")}) as distance from c, p group by 1),
    v as (select element_id, case when font in ('Brand#11', 'Brand#12') then 'forbidden' when font not in ('Brand#13', 'Brand#14', 'Brand#15') then 'off_font' end as kind, case when font in ('Brand#11', 'Brand#12') then 'high' else 'low' end as severity, font as found, null as expected from e
      union all select element_id, 'off_palette', case when distance < 0.3 then 'medium' else 'high' end, colour, entry from e join n using (colour) where distance > 0.05)
    select * from v where kind is not null""")
def brand_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = brands.Profile(palette=PALETTE, fonts=("Brand#13", "Brand#14", "Brand#15"), forbidden_fonts=("Brand#11", "Brand#12"))
    return brands.violations(elements(spark, sf_dir), profile, "element_id")


@query("""with s as (select (p_partkey * 37 % 256)::int as r, (p_partkey * 59 % 256)::int as g, (p_size * 5 % 256)::int as b, p_partkey % 13 + 1 as n from part),
    k as (select printf('#%02X%02X%02X', r // 8 * 8, g // 8 * 8, b // 8 * 8) as hex, sum(n)::bigint as count from s where (r + g + b) / 3 between 25 and 220 and greatest(r, g, b) - least(r, g, b) >= 35 group by 1 order by count desc, hex limit 12),
    d as (select *, row_number() over o as nth, lead(count) over o as after from k window o as (order by count desc, hex)),
    m as (select hex, count, (row_number() over (order by count desc, hex))::int as rank from d where not (nth = 1 and coalesce(count > 3 * after, false)))
    select hex, count, rank, case when rank = 1 then 'primary' when rank <= 4 then 'accent' else 'neutral' end as role from m where rank <= 8""")
def raster_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pixels = table(spark, sf_dir, "part").select((key * 37 % 256).cast("int").alias("r"), (key * 59 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b"), (key % 13 + 1).alias("n"))
    return brands.raster_palette(pixels, top=8)


@query(f"""with e as ({ELEMENTS_SQL}), c as (select colour as hex, count(*) as n from e group by 1 order by n desc, hex limit 3),
    a as (select hex, 0 as origin, (row_number() over (order by n desc, hex)) as i from c union all select '#' || upper(md5(o_orderpriority)[1:6]), 1, row_number() over (order by o_orderpriority) from (select distinct o_orderpriority from orders) union all select hex, 1, 100 + i from (select hex, row_number() over (order by n desc, hex) as i from c)),
    f as (select hex, min((origin, i)) as first from a group by 1)
    select hex, (row_number() over (order by first))::int as rank from f order by first limit 8""")
def merged_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few element colours first, topped up with others not among them."""
    own = brands.counted(elements(spark, sf_dir), "colour", 3)
    first = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(16)  # more than a palette shows
    others = first.select(F.concat(F.lit("#"), F.upper(F.substring(F.md5("o_orderpriority"), 1, 6))).alias("hex"), F.dense_rank().over(brands.everything("o_orderpriority")).alias("i"))
    return brands.topped_up(own, others.unionByName(own.select("hex", (F.col("i") + 100).alias("i"))), enough=4, top=8)


@query(f"""with e as ({ELEMENTS_SQL}), t as (select count(*) as n from e), f as (select font, count(*) as uses from e group by 1),
    r as (select font, uses, round(100.0 * uses / n, 2)::double as share, row_number() over (order by uses desc, font) as i from f, t)
    select font, uses, share, i::int as rank from r where i <= 6""")
def brand_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.shares(elements(spark, sf_dir), "font", 6).withColumn("share", F.round("share", 2))
