"""Formulas, spend, list changes, profiles and generated children on small known cases."""

import datetime

import pytest
from lathework.functions import findings, formulas
from lathework.operators import audits, graphs, grids, rollups, search, snapshots, spend
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def at(text):
    return F.lit(text).cast("timestamp")


def test_dates_in_formulas(spark):
    row = one(
        spark,
        month_end=formulas.date_add("month", 1, at("2024-01-31 10:00:00")),
        quarter=formulas.date_add("Quarter", -1, at("2024-05-31")),
        hours=formulas.date_add("hour", 25, at("2024-02-28 23:30:00")),
        new_year=formulas.date_diff("year", at("2023-12-31 23:59:59"), at("2024-01-01")),
        back=formulas.date_diff("month", at("2024-03-01"), at("2024-01-31")),
        weeks=formulas.date_diff("week", at("2024-01-07"), at("2024-01-08")),
        minutes=formulas.date_diff("minute", at("2024-01-01 00:00:59"), at("2024-01-01 00:01:00")),
        part=formulas.date_part("quarter", at("2024-11-05")),
        cut=formulas.date_trunc("week", at("2024-01-07 13:00:00")),
    )
    when = datetime.datetime
    assert (row.month_end, row.quarter, row.hours) == (when(2024, 2, 29, 10), when(2024, 2, 29), when(2024, 3, 1, 0, 30))
    assert (row.new_year, row.back, row.weeks, row.minutes, row.part, row.cut) == (1, -2, 1, 1, 4, when(2024, 1, 1))
    for bad in (lambda: formulas.date_add("fortnight", 1, F.lit(1)), lambda: formulas.date_diff("x", F.lit(1), F.lit(1)), lambda: formulas.date_part("", F.lit(1)), lambda: formulas.date_trunc("eon", F.lit(1))):
        with pytest.raises(ValueError):
            bad()


def test_other_formulas(spark):
    none = F.lit(None).cast("boolean")
    row = one(spark, a=formulas.iif(F.lit(True), "y", "n"), b=formulas.iif(F.lit(False), "y", "n"), c=formulas.iif(none, "y", "n"), d=formulas.iif(none, "y", "n", "?"), e=formulas.as_text(F.lit(5)), f=formulas.length(F.lit("héé")))
    assert tuple(row) == ("y", "n", None, "?", "5", 3)
    shown = spark.createDataFrame([("sum", "Sales"), ("avg", "Avg Sales"), ("none", "Region"), (None, "Region"), ("pcto", "Sales"), ("zzz", "x")], "a string, f string")
    assert [r.s for r in shown.select(formulas.shown_name(F.col("a"), F.col("f")).alias("s")).collect()] == ["SUM(Sales)", "Avg Sales", "Region", "Region", "%(Sales)", "ZZZ(x)"]


def test_parameters_are_never_guessed(spark):
    given = formulas.Parameters(limit=5)
    assert one(spark, x=given["limit"] + 1).x == 6 and one(spark, x=given.bound(limit=7)["limit"]).x == 7
    with pytest.raises(KeyError, match="top has no value"):
        given["top"]


def test_alert_ladder(spark):
    day = lambda m, d: datetime.datetime(2024, m, d)
    readings = [("a", day(1, 1), 19.0), ("a", day(1, 2), 61.0), ("a", day(1, 3), 45.0), ("a", day(1, 4), 80.0), ("a", day(1, 5), 99.0), ("a", day(2, 1), 21.0), ("b", day(1, 1), None), ("b", day(1, 2), 200.0)]
    got = spend.alert_ladder(spark.createDataFrame(readings, "k string, at timestamp, spent double"), "k", "at", "spent", 20.0, 80.0)
    want = [("a", day(1, 2), 20.0, False), ("a", day(1, 2), 40.0, False), ("a", day(1, 2), 60.0, False), ("a", day(1, 4), 80.0, True), ("a", day(2, 1), 20.0, False)]
    want += [("b", day(1, 2), 20.0 * i, i == 10) for i in range(1, 11)]
    assert sorted(map(tuple, got.collect())) == want


def test_statement_and_services(spark):
    day = datetime.date
    rows = [("x", "s1", "Usage", 10.0, day(2024, 1, 1)), ("x", "s2", "usage", 5.0, day(2024, 1, 5)), ("x", "s1", "Credit", -4.0, day(2024, 1, 2)), ("x", "s3", "Usage", 0.01, day(2024, 1, 2)), ("y", "s1", "Tax", 9.0, day(2024, 1, 1))]
    df = spark.createDataFrame(rows, "org string, service string, kind string, amount double, day date")
    got = {r.org: tuple(r)[1:] for r in spend.statement(df, ["org"], "kind", "amount", "day").collect()}
    assert got["x"] == pytest.approx((15.01, -4.0, 11.01, 5, 3.002)) and got["y"] == (0.0, 0.0, 0.0, 1, 0.0)
    top = spend.top_services(df, ["org"], "service", "kind", "amount").collect()
    assert [(r.service, r.nth) for r in top] == [("s1", 1), ("s2", 2)]


def test_reordering(spark):
    rows = spark.createDataFrame([("g", 1, 1.0, "a"), ("g", 2, 2.0, "b"), ("g", 3, 3.0, "c"), ("h", 1, 1.0, "z")], "g string, k int, place double, body string")
    ops = [("g", 3, 1, "move", 0.5, None), ("g", 1, 2, "delete", None, None), ("g", 2, 3, "duplicate", 0.25, 9), ("g", 3, 0, "delete", None, None), ("g", 77, 4, "move", 5.0, None)]
    got = snapshots.reordered(rows, spark.createDataFrame(ops, "g string, k int, at int, op string, place double, new_key int"), "g", "k", "place").orderBy("g", "position").collect()
    assert [(r.g, r.k, r.body, r.position) for r in got] == [("g", 9, "b", 1), ("g", 3, "c", 2), ("g", 2, "b", 3), ("h", 1, "z", 1)]


def test_updates(spark):
    rows = spark.createDataFrame([(1, "new", 5), (2, "old", None)], "id int, status string, n int")
    changes = [(1, 1, "status", "x"), (1, 3, "status", None), (1, 2, "n", "7"), (2, 1, "id", "9"), (3, 1, "n", "1")]
    got = snapshots.updated(rows, spark.createDataFrame(changes, "id int, at int, field string, value string"), "id", "at", ["status", "n"])
    assert sorted(map(tuple, got.collect())) == [(1, None, 7), (2, "old", None)]


def test_prints(spark):
    a = snapshots.element_print({"x": F.lit(1.23456), "y": F.lit(None)}, {"text": F.lit("t" * 200), "none": F.lit("")})
    b = snapshots.element_print({"x": F.lit(1.2349), "y": F.lit(None)}, {"text": F.lit("t" * 120), "none": F.lit(None)})
    row = one(spark, a=a, b=b)
    assert row.a == row.b == '{"x":1.235,"text":"' + "t" * 120 + '"}'


def test_profiles(spark):
    rows = [("d", 1, "F1", "#1", True), ("d", 2, "F2", "#2", None), ("d", 3, "F2", "#1", False), ("d", 4, "F1", None, True), ("e", 5, None, None, None)]
    got = {r.deck: r for r in rollups.style_profile(spark.createDataFrame(rows, "deck string, at int, font string, colour string, bold boolean"), "deck", {"font": "font"}, {"colours": ("colour", 2)}, {"bold": F.col("bold")}, "at").collect()}
    assert (got["d"].font, got["d"].colours, got["d"].bold, got["d"].members) == ("F1", ["#1", "#2"], True, 4)
    assert (got["e"].font, got["e"].bold, got["e"].members) == (None, None, 1)


def test_generated_children(spark):
    groups = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "g string, n int")
    old = spark.createDataFrame([("a", 1, "kept", True), ("a", 2, "gone", False), ("b", 4, "kept", True)], "g string, nth int, body string, locked boolean")
    got = audits.generated(groups, old, "g", ["n"], lambda g, n: [f"{g}{i}" for i in range(n)])
    assert sorted(map(tuple, got.collect())) == [("a", 1, "kept", True), ("a", 2, "a1", False), ("b", 4, "kept", True), ("c", 1, "c0", False), ("c", 2, "c1", False), ("c", 3, "c2", False)]


def test_chart_and_table_data(spark):
    schema = "deck string, page int, shape int, kind string, categories array<string>, series array<struct<name string, values array<double>>>, rows array<array<string>>, has_header boolean"
    rows = [("d", 1, 42, "chart", ["a"], [("", [1.0, None]), ("n", [])], None, None), ("d", 1, 43, "table", None, None, [["h", None], ["x", "y"]], True), ("d", 2, 1, "table", None, None, [["x", "y"]], None), ("d", 2, 2, "text", None, None, None, None)]
    got = sorted(map(tuple, grids.extracted(spark.createDataFrame(rows, schema), ["deck"]).collect()), key=str)
    assert got == sorted([("d", 1, 42, 0, "Series_0", "a", "1.0"), ("d", 1, 42, 1, "Series_0", None, None), ("d", 1, 43, 0, "h", None, "x"), ("d", 1, 43, 0, "column_1", None, "y"), ("d", 2, 1, 0, "column_0", None, "x"), ("d", 2, 1, 0, "column_1", None, "y")], key=str)
    charts = spark.createDataFrame([(1, ["a"], [("", [1.0, 2.0]), ("n", [])]), (2, [], [])], "k int, categories array<string>, series array<struct<name string, values array<double>>>")
    assert sorted(map(tuple, grids.category_rows(charts, "k").collect()), key=str) == sorted([(1, 0, "a", "Series 1", 1.0), (1, 1, "Cat 2", "Series 1", 2.0), (1, 0, "a", "n", None), (1, 1, "Cat 2", "n", None)], key=str)


def test_category_levels(spark):
    """The known case of three levels; a missing label is empty."""
    labels = [(0, 0, "SF"), (0, 1, "LA"), (0, 2, "NY"), (0, 3, "Albany"), (0, 4, "Ottawa"), (1, 0, "CA"), (1, 2, "NY"), (1, 4, None), (2, 0, "USA"), (2, 4, "CAN")]
    got = grids.flattened_categories(spark.createDataFrame([("k", *x) for x in labels], "k string, level int, idx int, label string"), "k").orderBy("idx").collect()
    assert [tuple(r.path) for r in got][:4] == [("USA", "CA", "SF"), ("USA", "CA", "LA"), ("USA", "NY", "NY"), ("USA", "NY", "Albany")]
    none = grids.flattened_categories(spark.createDataFrame([("k", 0, 0, "x"), ("k", 1, 1, "late"), ("k", 0, 1, "y")], "k string, level int, idx int, label string"), "k").orderBy("idx").collect()
    assert [tuple(r.path) for r in none] == [("", "x"), ("late", "y")]


def test_merged_cells_are_counted(spark):
    cells = spark.createDataFrame([("t", r, c, "x", None, None) for r in range(3) for c in range(3)] + [("u", 0, 0, None, "#1", None)], "t string, row int, col int, text string, fill string, border string")
    merges = spark.createDataFrame([("t", 0, 0, 1, 1), ("t", 2, 2, 2, 2)], "t string, top int, left int, bottom int, right int")
    got = {r.t: (r.n_cells, r.filled, r.merged) for r in audits.merged_facts(cells, merges, "t").collect()}
    assert got == {"t": (9, 0, 4), "u": (1, 1, 0)}


def test_recent_or_scored(spark):
    rows = spark.createDataFrame([(i, f"name{i}", i * 7 % 20) for i in range(20)], "id int, name string, changed int")
    score = F.when(F.contains("name", F.lit("1")), 5).otherwise(0)
    recent = search.recent_or_scored(rows, "  ", score, "changed", ["id"]).collect()
    assert [r.changed for r in recent] == list(range(19, 11, -1)) and {r.score for r in recent} == {1}
    assert search.recent_or_scored(rows, "1", score, "changed", ["id"]).count() == 11


def test_findings_of_many_secrets(spark):
    """Lines and excerpts over more matches than a block holds, against a loop over the text."""
    import re

    key = "gh" + "p_"
    text = "".join(f"row {i}\n" * (i % 3) + f"x {key}{i:036d} y {key}{i + 500:036d}\n" for i in range(150))
    got = findings.findings(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    want = []
    for m in re.finditer(findings.PATTERNS["github_pat"], text):
        line = text.count("\n", 0, m.start()) + 1
        want.append((1, "github_pat", line, text.split("\n")[line - 1].replace(m.group(), "[REDACTED-40]")[:200]))
    assert [tuple(r) for r in got] == want and len(want) == 300


def test_reachable_over_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(25, 3)], "source int, target int")
    got = graphs.reachable(edges, spark.createDataFrame([(0,)], "node int")).collect()
    assert sorted((r.node, r.depth) for r in got) == [(i, i) for i in range(26)]


def test_materials(spark):
    from lathework.operators import materials

    secret = "key = AKI" + "A" + "Q" * 16
    rows = [(1, "a.csv", "h1,h2\n1,2\n3,4\n5,6"), (2, "b.md", "one fetch_revenue\n\ntwo\n \n\nthree"), (3, "c.txt", f"x\n{secret}"), (4, "d.txt", None), (5, "noend", "text")]
    verdict, chunks = materials.taken_in(spark.createDataFrame(rows, "material_id int, filename string, text string"), size=2)
    got = {r.material_id: (r.refused, [tuple(f) for f in r.findings], r.chunks) for r in verdict.collect()}
    assert got == {1: (False, [], 3), 2: (False, [], 3), 3: (True, [(2, "aws_access_key")], 0), 4: (False, [], 0), 5: (False, [], 1)}
    made = chunks.orderBy("material_id", "nth").collect()
    assert [(r.material_id, r.kind, r.nth, r.text) for r in made[:3]] == [(1, "csv_header", 0, "h1,h2"), (1, "csv_rows", 1, "h1,h2\n1,2\n3,4"), (1, "csv_rows", 3, "h1,h2\n5,6")]
    assert made[3].tokens == ["fetch", "fetch_revenue", "one", "revenue"] and not any(r.material_id == 3 for r in made)


def test_typed_templates(spark):
    from lathework.functions import text

    rows = [("{{ n }}", "5"), ("{{l}}", "[1, 2]"), ("{{s}}", '"a\\"b"'), ("x {{s}} y", '"x a\\"b y"'), ("{{missing}}", '""'), ("a{{missing}}b", '"ab"'), ("plain", '"plain"'), (None, None), ("{{n}}{{n}}", '"55"'), ("{{l}}!", '"[1,2]!"')]
    inputs = F.create_map(F.lit("n"), F.lit("5"), F.lit("l"), F.lit("[1, 2]"), F.lit("s"), F.lit('"a\\"b"'))
    got = spark.createDataFrame(rows, "t string, want string").select("want", text.typed_template(F.col("t"), inputs).alias("got")).collect()
    assert [(r.got or "").replace(" ", "") for r in got] == [(r.want or "").replace(" ", "") for r in got]


def test_cell_rules(spark):
    from lathework.functions import values

    rows = [("12 %",), ("-3",), ("abc",), (None,), (".5x",), ("1e2",)]
    got = spark.createDataFrame(rows, "t string").select(values.by_rule(F.col("t"), "<", 1, "low", "high").alias("f")).collect()
    assert [r.f for r in got] == ["high", "low", None, None, "low", "high"]
    with pytest.raises(ValueError):
        values.by_rule(F.col("t"), "!=", 1, None, None)


def test_markdown_and_extracts(spark, tmp_path):
    from lathework.sources import files

    df = spark.createDataFrame([(2, "b|c"), (1, None), (3, "x")], "n int, t string").repartition(3)
    files.markdown(df, str(tmp_path / "md"), order=["n"])
    parts = sorted(p for p in (tmp_path / "md").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == "| n | t |\n| --- | --- |\n| 1 |  |\n| 2 | b\\|c |\n| 3 | x |\n"
    wide = spark.createDataFrame([("Q1", 100, 80), ("Q2", 120, 90)], "quarter string, revenue int, cost int")
    files.extract(wide, str(tmp_path / "long"), "quarter")
    assert spark.read.parquet(str(tmp_path / "long")).count() == 4


def test_shares_of_nothing(spark):
    from lathework.operators import reshape

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), ("z", 0.0), ("z", None)], "g string, v double")
    assert sorted(r.share for r in reshape.shares(df, "v", ["g"]).collect()) == [0.0, 0.0, 0.25, 0.75, 1.0]
    assert reshape.shares(df.limit(0), "v", []).count() == 0


def test_shelf_order(spark):
    from lathework.operators import worksheet

    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 5)], "d string, m int")
    order = lambda *a: "".join(r.d for r in worksheet.shelf_sorted(df, "d", *a).collect())
    assert (order("m", "DESC"), order("m"), order(), order(None, "desc")) == ("dabc", "abdc", "abcd", "dcba")


def test_expanded_operations_lie_together_by_member(spark):
    operations = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, id + 100, id % 2) as g").unionByName(spark.sql("select -1L as id, null as g union all select 7, 1 union all select 7, 1"))
    members = spark.range(30).selectExpr("id % 2 as g", "id + 1000000 as m")
    got = audits.expanded(operations, members, "g", "m")
    assert got.columns == ["id", "g", "target"]
    plain = operations.join(members, "g", "left").selectExpr("id", "g", "coalesce(m, g) as target")
    assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()
    target = got.filter("g < 2").select("target").toPandas().target
    assert (target != target.shift()).sum() < len(target) / 20
    assert audits.expanded(operations.limit(0), members, "g", "m").isEmpty()
    assert got.filter("id = -1").first().target is None
