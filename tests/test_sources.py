"""Sources and sinks on small files, and functions that have known cases rather than a query."""

import json

import pytest
from lathework.functions import layout, phrases, text, values
from lathework.operators import graphs, relate, reshape, search, workspace, worksheet
from lathework.sources import files
from pyspark.sql import functions as F


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("quarter,revenue\nQ1,100\nQ2,\n")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv")).collect()] == [("Q1", 100), ("Q2", None)]
    assert files.csv(spark, str(tmp_path / "a.csv"), "quarter string, revenue double").dtypes[1] == ("revenue", "double")
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.txt").write_text("one\ntwo\n")
    assert sorted(r.x for r in files.by_suffix(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    assert files.by_suffix(spark, str(tmp_path / "c.txt")).count() == 2 and files.by_suffix(spark, str(tmp_path / "a.csv"), "quarter string, revenue int").columns == ["quarter", "revenue"]
    with pytest.raises(ValueError):
        files.by_suffix(spark, "a.xyz")


def test_rows_of_the_driver(spark):
    assert files.records(spark, [{"a": 1, "b": "x"}], "a int, b string").first().b == "x"
    assert [tuple(r) for r in files.columns(spark, {"a": [1, 2], "b": ["x", None]}, "a int, b string").collect()] == [(1, "x"), (2, None)]


def test_corpus_lists_files(spark, tmp_path):
    for name in ("a.pptx", "deep/b.PDF", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = {(r.path.rsplit("/", 1)[-1], r.kind, r.length) for r in files.corpus(spark, str(tmp_path)).collect()}
    assert found == {("a.pptx", ".pptx", 5), ("b.PDF", ".pdf", 5)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", 2.0), (2, None, None)], "id int, name string, v double")
    for _ in range(2):
        files.append(rows, str(tmp_path / "t"), by="id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    files.json_report(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    files.markdown(rows.coalesce(1), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| 1 | a\\|b | 2.0 |", "| 2 |  |  |"]
    files.bundle(rows.withColumn("page", F.lit(3)), str(tmp_path / "b"), "page")
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "b" / "summary")).select("page", "elements").collect()] == [(3, 2)]


def test_tagged_documents_round_trip(spark):
    rows = spark.createDataFrame([(1, "a", [1.5, None]), (2, None, None)], "id int, name string, points array<double>")
    bodies = files.tagged(rows, "id", "Note")
    assert json.loads(bodies.filter("id = 2").first().body) == {"__type__": "Note"}
    more = bodies.union(spark.createDataFrame([(3, '{"__type__": "Other"}'), (4, "broken"), (5, None)], "id int, body string"))
    assert sorted(map(tuple, files.untagged(more, "id", "Note", "name string, points array<double>").collect())) == sorted(map(tuple, rows.collect()))


def test_latest_rows_of_a_stream(spark, tmp_path):
    for n, batch in enumerate([[(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], [(1, 2, "late"), (2, 5, "y")]]):
        spark.createDataFrame(batch, "key int, at int, v string").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema("key int, at int, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    sink = files.latest_sink(str(tmp_path / "out"), "key", "at")
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, files.latest_of(spark, str(tmp_path / "out"), "key", "at").collect())) == [(1, 3, "c"), (2, 5, "y")]


def test_pasted_series(spark):
    lines = spark.createDataFrame([("North\t$1,200\t3.5",), ('"South",5,x',), ("alone",), ("NaNs,NaN,Infinity",)], "line string")
    got = [(r.name, r["values"]) for r in reshape.pasted_series(lines).collect()]
    assert got == [("North", [1200.0, 3.5]), ("South", [5.0, None]), ("NaNs", [None, None])]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_layout_cases(spark):
    lit = F.lit
    assert [one(spark, layout.emu(lit(1), u)) for u in layout.EMU] == [914400, 360000, 36000, 12700, 127]
    assert one(spark, layout.from_emu(lit(914400), "inches")) == 1.0
    assert [one(spark, layout.aspect(lit(float(w)), lit(float(h)))) for w, h in ((13.333, 7.5), (10, 7.5), (1, 1), (9, 16), (4, 5), (3, 1), (1, 3), (0, 1))] == ["landscape_16_9", "landscape_4_3", "square", "portrait_9_16", "portrait_4_5", "landscape_16_9", "portrait_9_16", "landscape_16_9"]
    assert one(spark, layout.fitted_font(lit(24.0), lit(50), lit(4.0), lit(0.5))) < 24 and one(spark, layout.fitted_font(lit(24.0), lit(5), lit(4.0), lit(0.5))) == 24
    assert one(spark, layout.estimated_tokens(lit("abcd"), lit("ab"))) == 1.5
    assert [one(spark, layout.shown_number(lit(0.256), lit(f))) for f in ("0%", "$0", "0.00", "0.0", "x")] == ["26%", "$0", "0.26", "0.3", "0.256"]


def test_quadrants_and_serials(spark):
    boxes = {(0, 0, 2, 1): "top-left", (11, 0.2, 2, 1): "top-right", (5, 3, 3, 1.5): "center", (4, 6, 5, 1): "bottom-center"}
    for box, place in boxes.items():
        assert one(spark, values.quadrant(*(F.lit(float(x)) for x in box))) == place
    date = lambda d: F.lit(d).cast("date")
    assert [one(spark, values.spreadsheet_serial(date(d), epoch)) for d, epoch in (("2016-12-22", False), ("1999-12-31", True), ("1900-02-28", False), ("1990-09-01", True))] == [42726, 35063, 59, 31655]


def test_phrases(spark):
    said = F.lit("Move the Logo to the upper right, not the graphite one")
    assert one(spark, phrases.named_types(said)) == ["image"] and one(spark, phrases.named_places(said)) == ["top-right", "middle-right"]
    assert one(spark, phrases.want_name(F.lit("The Slide  Title Placeholder"))) == "slide title"
    assert [one(spark, phrases.json_within(F.lit(x))) for x in ('```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} it is', "none", "{broken")] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]


def test_element_search_cases(spark):
    rows = [(1, 1, "chart", "top-left", 3), (2, 1, "chart", "center", 5), (3, 2, "text", "top-left", 1), (4, 9, "text", "center", 1)]
    found = spark.createDataFrame(rows, "element_id long, page int, kind string, place string, z int")
    got = search.ranked_elements(found, "it", viewing=2, selected=3).collect()
    assert [(r.element_id, r.confidence) for r in got] == [(3, 1.0)]
    got = search.ranked_elements(found, "the chart", viewing=1).collect()
    assert [r.element_id for r in sorted(got, key=lambda r: -r.confidence)][:2] in ([1, 2], [2, 1]) and sum(r.ambiguous for r in got) == 1
    assert search.ranked_elements(found, "the chart", viewing=1, pages=[9], kinds=["table"]).count() == 0


def test_cycles_are_found(spark):
    groups = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, parent string")
    whole = groups.withColumns({c: F.lit(1.0) for c in ("off_x", "off_y", "scale_x", "scale_y")})
    with pytest.raises(ValueError):
        graphs.composed(whole).count()
    long = spark.range(1, 200).selectExpr("cast(id as string) as id", "if(id > 1, cast(id - 1 as string), null) as parent").withColumns({"off_x": F.lit(1.0), "off_y": F.lit(0.0), "scale_x": F.lit(1.0), "scale_y": F.lit(1.0)})
    assert graphs.composed(long).filter("id = '199'").first().off_x == 199.0
    nodes = spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 1, "v"), (4, 3, None), (5, None, None)], "id int, up int, v string")
    assert sorted(map(tuple, relate.inherited(nodes, "id", "up", "v", "none").collect())) == [(1, "none"), (2, "none"), (3, "v"), (4, "v"), (5, "none")]


def test_approximate_measures(spark):
    numbers = spark.range(20000).selectExpr("id % 3 as k", "id as v")
    exact = [worksheet.Measure("n", F.col("v"), "countd"), worksheet.Measure("m", F.col("v"), "med")]
    rough = [worksheet.Measure(m.name, m.of, m.aggregate, approximate=True) for m in exact]
    for a, b in zip(*(worksheet.worksheet(numbers, F.col("k"), m, ranked=False).collect() for m in (exact, rough)), strict=True):
        assert abs(a.n - b.n) <= 0.1 * a.n and abs(a.m - b.m) <= 0.02 * 20000


def test_names_still_free(spark):
    used = spark.createDataFrame([("a", "rId1"), ("a", "rId3"), ("b", "rId1"), ("b", "rId2"), ("c", "rId4"), ("c", "rId3"), ("d", "x")], "g string, name string")
    assert {r.g: r.next for r in workspace.free_number(used, "g", "name", "rId").collect()} == {"a": 2, "b": 3, "c": 2, "d": 2}


def test_metric_text(spark):
    assert [one(spark, text.metric_value(F.lit(v))) for v in ("$4.2M", "23%", "1,250", "100K", "-")] == [4200000.0, 0.23, 1250.0, 100000.0, None]
