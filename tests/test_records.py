"""Exact joins, logs, geometry, stored roll-ups and workbooks against plain versions on awkward rows."""

import collections
import itertools
import random

import pytest
from lathework.operators import geometry, graphs, history, relate, similarity, sketches, spend, workspace
from lathework.sources import workbooks
from pyspark.sql import functions as F


def plain_pairs(sets, least):
    out = []
    for (a, x), (b, y) in itertools.combinations(sorted((i, set(s)) for i, s in sets if s), 2):
        shared = len(x & y)
        if shared / len(x | y) >= least:
            out.append((a, b, shared, round(shared / len(x | y), 9)))
    return sorted(out)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("block", [3, 2048])
def test_similar_pairs(spark, monkeypatch, least, block):
    """All pairs, among them copies, subsets, empty and null sets, and tokens that most rows have; places are split with a block of 3."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(1)
    sets = [(i, [f"t{int(rng.paretovariate(0.6)) % 40}" for _ in range(rng.randrange(0, 12))]) for i in range(120)]
    sets += [(200 + i, s) for i, (_, s) in enumerate(sets[:15])] + [(300, None), (301, []), (302, [None, "t1"]), (303, ["t1", "t1"]), (304, ["t1"])]
    got = similarity.similar_pairs(spark.createDataFrame(sets, "id long, tokens array<string>"), "id", "tokens", least).collect()
    plain = [(i, [x for x in s or [] if x is not None]) for i, s in sets]
    assert sorted((r.a, r.b, r.shared, round(r.similarity, 9)) for r in got) == plain_pairs(plain, least)


def test_similar_pairs_shuffle_no_candidates(spark, monkeypatch):
    """Sets that all share frequent tokens and are hardly alike: blocks are compared without a shuffle of pairs. Copies come once, with their set's first row."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "STEP", 64)
    rng = random.Random(4)
    sets = [(i, [f"t{j}" for j in range(12) if rng.random() < 0.7] + [f"u{rng.randrange(200)}" for _ in range(20)]) for i in range(90)]
    sets += [(100 + i, sets[i % 3][1]) for i in range(40)]
    found = similarity.similar_pairs(spark.createDataFrame(sets, "id long, tokens array<string>"), "id", "tokens", 0.2, copies=False)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    star = [(i % 3, 100 + i, len(set(sets[i % 3][1])), 1.0) for i in range(40)]
    assert sorted((r.a, r.b, r.shared, round(r.similarity, 9)) for r in found.collect()) == sorted(plain_pairs(sets[:90], 0.2) + star)


@pytest.mark.parametrize("step, short, later, dense", [(1 << 22, 64, 0.4, 0.01), (512, 2, 0.9, 0.05), (64, 0, 0.0, 0.3), (4096, 0, 1.0, 2.0)])
def test_similar_pairs_by_kind(spark, monkeypatch, step, short, later, dense):
    """Two kinds that share few tokens, sets of unequal sizes, a kind that is null: whatever is counted by which means, all pairs come, also across kinds."""
    for name, value in {"BLOCK": 40, "STEP": step, "SHORT": short, "LATER": later, "DENSE": dense}.items():
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(9)
    draw = lambda letter: [f"{letter}{min(int(rng.paretovariate(0.5)), 90)}" for _ in range(rng.choice([2, 8, 30]))]
    rows = [(i, "xyz"[i % 3], draw("x" if i % 3 else "y") + (["both"] if i % 5 else [])) for i in range(150)]
    rows += [(200, None, rows[0][2] + rows[1][2]), (201, "x", rows[3][2])]
    want = plain_pairs([(i, tokens) for i, _, tokens in rows], 0.2)
    got = similarity.similar_pairs(spark.createDataFrame(rows, "id long, lang string, tokens array<string>"), "id", "tokens", 0.2, kind="lang").collect()
    assert sorted((r.a, r.b, r.shared, round(r.similarity, 9)) for r in got) == want and len(want) > 300


def test_similar_pairs_take_tokens_twice(spark):
    """Tokens are made once for the digests and once for the blocks, not again to tell which are empty or where sets belong."""
    made = spark.sparkContext.accumulator(0)

    def tokens(n):
        made.add(1)
        return [f"t{n % 7}", f"u{n % 5}", f"v{n}"] if n else []

    docs = spark.range(0, 400, 1, 4).select("id", F.udf(tokens, "array<string>")("id").alias("tokens"))
    assert similarity.similar_pairs(docs, "id", "tokens", 0.4).count() > 0
    assert made.value <= 2 * 400


def test_similar_pairs_of_nothing(spark):
    assert similarity.similar_pairs(spark.createDataFrame([], "id long, tokens array<string>"), "id", "tokens", 0.5).count() == 0
    with pytest.raises(ValueError):
        similarity.similar_pairs(spark.createDataFrame([], "id long, tokens array<string>"), "id", "tokens", 0.0)


def plain_log(rows):
    """By stacks; a refused request changes nothing and is left out of the log."""
    undo, redo, log, states = collections.defaultdict(list), collections.defaultdict(list), [], {}
    for key, at, op in rows:
        u, r = undo[key], redo[key]
        if (op == "undo" and not u) or (op == "redo" and not r):
            continue
        if op == "do":
            u.append(at)
            r.clear()
        elif op == "undo":
            r.append(u.pop())
        else:
            u.append(r.pop())
        log.append((key, at, op))
        states[key, at] = (len(u), len(r), u[-1] if u else None)
    return log, states, {k: list(v) for k, v in undo.items()}


def test_undo_and_redo(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, rng.choice(["do", "do", "undo", "undo", "redo"])) for i in range(400)]
    log, states, stacks = plain_log(rows)
    df = spark.createDataFrame(log, "k string, at long, op string")
    got = history.undone(df, "k", ["at"], "op").collect()
    assert {(r.k, r["at"]): (r.undo_depth, r.redo_depth, r.current and r.current["at"]) for r in got} == states
    live = history.live_steps(df, "k", ["at"], "op").collect()
    assert sorted((r.k, r.depth, r.step["at"]) for r in live) == sorted((k, i + 1, s) for k, v in stacks.items() for i, s in enumerate(v))
    assert history.refused(df, "k", ["at"], "op").count() == 0
    bad = spark.createDataFrame([("x", 1, "undo"), ("y", 1, "do"), ("y", 2, "redo"), ("z", 1, "do"), ("n", 1, None)], "k string, at long, op string")
    assert sorted(r.k for r in history.refused(bad, "k", ["at"], "op").collect()) == ["x", "y"]
    assert history.undone(df.limit(0), "k", ["at"], "op").count() == 0


def plain_first(rows):
    names, sets, out = set(), set(), []
    for i, name, ids, always in sorted(rows):
        if always:
            out.append(i)
        elif (name is None or name not in names) and (ids is None or ids not in sets):
            out.append(i)
            names |= {name} - {None}
            sets |= {ids} - {None}
    return out


def test_first_without_conflict(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *map(str, range(25))]), rng.choice([None, *map(str, range(30))]), rng.random() < 0.1) for i in range(300)]
    rows += [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}", False) for i in range(60)]  # a chain in which every other one stays
    run = lambda rows: history.first_without_conflict(spark.createDataFrame(rows, "i long, name string, ids string, always boolean"), "i", {"name": F.col("name"), "ids": F.col("ids")}, F.col("always"))
    assert sorted(r.i for r in run(rows).collect()) == plain_first(rows)
    assert run([(1, None, None, None)]).count() == 1
    assert run([(1, "a", "b", True), (2, "a", "b", True)]).count() == 2


def test_want_names(spark):
    names = ["Slide Title", "slide  title Placeholder", "The Slide Title", None, "  ", "a tiny text box", "Group of Blocks"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(history.want_name(F.col("n")).alias("w")).collect()
    assert [r.w for r in got] == ["slide title", "slide title", "slide title", None, None, None, "of s"]


def plain_snap(values, tolerance):
    out, low = {}, None
    for v in sorted(set(values)):
        if low is None or not v <= low + tolerance:
            low = v
        out[v] = low
    return out


def test_snapped(spark):
    rng = random.Random(2)
    rows = [("a", rng.randrange(400) / 4) for _ in range(200)] + [("b", float(i)) for i in range(130)] + [("c", 5.0), ("c", None), (None, 1.0), (None, 1.5), (None, 9.0)]
    got = geometry.snapped(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 1.5).collect()
    want = {}
    for g in {r[0] for r in rows}:
        want |= {(g, v): s for v, s in plain_snap([v for h, v in rows if h == g and v is not None], 1.5).items()}
    assert {(r.g, r.v): r.snapped for r in got if r.g} == {k: v for k, v in want.items() if k[0]}
    whole = geometry.snapped(spark.createDataFrame(rows, "g string, v double"), [], "v", 0.0).collect()
    assert all(r.v == r.snapped for r in whole)


def rectangles(rng, n, pages):
    out = []
    for i in range(n):
        size = rng.choice([0, 0.25, 1, 3, 40, 700])
        x, y = rng.randrange(-400, 400) / 4, rng.randrange(-400, 400) / 4
        out.append((rng.randrange(pages), i, x, y, x + size * rng.choice([0.1, 1]), y + size * rng.choice([0.05, 1])))
    return out


def test_points_in_boxes_of_very_unequal_size(spark):
    rng = random.Random(3)
    boxes, points = rectangles(rng, 150, 3), [(rng.randrange(4), i, rng.randrange(-480, 480) / 4, rng.randrange(-480, 480) / 4) for i in range(300)]
    b, p = spark.createDataFrame(boxes, "page int, box_id long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(points, "page int, point_id long, x double, y double")
    for slack in (0.0, 2.0):
        got = geometry.boxes_around(p, b, ["page"], finest=1.0, slack=slack).collect()
        want = [(page, i, j) for page, i, x, y in points for q, j, x0, y0, x1, y1 in boxes if q == page and x0 - slack <= x <= x1 + slack and y0 - slack <= y <= y1 + slack]
        assert sorted(map(tuple, got)) == sorted(want)
    assert geometry.boxes_around(p, b.limit(0), ["page"]).count() == 0


def test_heaps_of_boxes_and_points_meet_once(spark, monkeypatch):
    """Copies of a few boxes and places, nulls among them: only different ones are looked up."""
    rng = random.Random(9)
    boxes = [(1000 - i, *[(0.0, 0.0, 9.0, 9.0), (4.0, 4.0, 20.0, 6.0), (30.0, 30.0, 30.0, 31.0), (None, 0.0, 1.0, 1.0)][i % 4]) for i in range(80)]
    points = [(i, *[(5.0, 5.0), (1.0, 2.0), (30.0, 30.5), (None, 3.0), (70.0, 1.0)][rng.randrange(5)]) for i in range(200)]
    b, p = spark.createDataFrame(boxes, "box_id long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(points, "point_id long, x double, y double")
    met = []
    around = geometry.boxes_around
    monkeypatch.setattr(geometry, "boxes_around", lambda *args: met.append(around(*args)) or met[-1])
    got = {r.point_id: r.box_id for r in relate.points_in_boxes(p, b, 2.0, 0.5).collect()}
    holds = lambda box, x, y: None not in (*box, x) and box[1] - 0.5 <= x <= box[3] + 0.5 and box[2] - 0.5 <= y <= box[4] + 0.5
    want = {i: [box[0] for box in boxes if holds(box, x, y)] for i, x, y in points}
    assert got == {i: min(ids) for i, ids in want.items() if ids}
    assert met and met[0].count() <= 6


def test_consumed_blocks(spark):
    lines = [(1, 7, n, x, 0.0, x + 2, 2.0, full) for n, (x, full) in enumerate([(0, True), (1, True), (2, True), (3, True), (90, True), (95, False)])] + [(1, 8, 9, 200.0, 0.0, 201.0, 1.0, False), (2, 7, 10, 0.0, 0.0, 1.0, 1.0, True)]
    lines = [(a, b, c, float(d), e, float(f), g, h) for a, b, c, d, e, f, g, h in lines]
    df = spark.createDataFrame(lines, "page int, block_id int, line_id int, x0 double, y0 double, x1 double, y1 double, full boolean")
    cells = spark.createDataFrame([(1, 2, 0.0, 0.0, 5.0, 5.0), (1, 1, 3.0, 0.0, 9.0, 5.0)], "page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.block_id): (r.lines, r.placed, r.consumed) for r in geometry.consumed_blocks(df, cells, ["page"], F.col("full")).collect()}
    assert got == {(1, 7): (5, 4, True), (1, 8): (0, 0, False), (2, 7): (1, 0, False)}
    first = {r.line_id: r.cell for r in geometry.lines_in_cells(df, cells, ["page"]).collect()}
    assert first[0] == 1 and first[3] == 1 and first[4] is None  # of two cells the first


def test_crossings_and_cells(spark):
    rng = random.Random(8)
    lines = [(rng.randrange(3), i, rng.random() < 0.5, rng.randrange(80) / 4, (low := rng.randrange(60) / 4), low + rng.randrange(60) / 4) for i in range(240)]
    df = spark.createDataFrame(lines, "page int, line_id long, across boolean, at double, low double, high double")
    t = 0.5
    meets = lambda a, b: a[0] == b[0] and a[2] != b[2] and a[4] - t <= b[3] <= a[5] + t and b[4] - t <= a[3] <= b[5] + t
    want = {a[1]: sum(meets(a, b) for b in lines) for a in lines}
    assert {r.line_id: r.crossed for r in geometry.crossings(df, ["page"], t).collect()} == want
    cells = []
    for page in range(3):
        places = {}
        for across in (True, False):
            snap = plain_snap([x[3] for x in lines if x[0] == page and x[2] == across and want[x[1]] >= 2], t)
            places[across] = sorted(set(snap.values()))
        cells += [(page, i, j, x0, y0, x1, y1) for i, (y0, y1) in enumerate(itertools.pairwise(places[True])) for j, (x0, x1) in enumerate(itertools.pairwise(places[False]))]
    assert cells and sorted(map(tuple, geometry.ruled_cells(df, ["page"], t).collect())) == sorted(cells)
    assert geometry.ruled_cells(df.filter("across"), ["page"], t).count() == 0


def test_lines_at_one_place_are_swept_together(spark):
    """Many copies of few lines, lines without a position and with exchanged ends: counts are those of pairs, and copies add no rows to the sweep."""
    rng = random.Random(10)
    kinds = [(rng.random() < 0.5, float(rng.randrange(6)), float(low := rng.randrange(5)), float(low + rng.randrange(-1, 5))) for _ in range(12)] + [(True, None, 0.0, 9.0), (False, 2.0, None, 9.0)]
    lines = [(1, i, *kinds[rng.randrange(14)]) for i in range(150)]
    df = spark.createDataFrame(lines, "page int, line_id long, across boolean, at double, low double, high double")
    meets = lambda a, b: a[2] != b[2] and None not in (*a, *b) and a[4] - 0.25 <= b[3] <= a[5] + 0.25 and b[4] - 0.25 <= a[3] <= b[5] + 0.25
    assert {r.line_id: r.crossed for r in geometry.crossings(df, ["page"], 0.25).collect()} == {a[1]: sum(meets(a, b) for b in lines) for a in lines}
    assert geometry._crossed(df, ["page"], 0.25).count() <= 12


def test_copies_of_boxes_are_near_as_one(spark, monkeypatch):
    """Copies link to their least; boxes with nulls or far exchanged edges stay alone, as before."""
    kinds = [(1, 0.0, 0.0, 1.0, 1.0), (1, 1.5, 0.0, 2.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (1, 50.0, 0.0, 40.0, 1.0), (1, None, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)]
    boxes = [(kinds[i % 6][0], 100 - i, *kinds[i % 6][1:]) for i in range(60)]
    df = spark.createDataFrame(boxes, "page int, box_id long, x0 double, y0 double, x1 double, y1 double")
    links = []
    components = graphs.components
    monkeypatch.setattr(graphs, "components", lambda x: links.append(x.count()) or components(x))
    got = {r.box_id: r.cluster for r in geometry.near_boxes(df, ["page"], 1.0).collect()}
    least = {0: min(b for i, (_, b, *_) in enumerate(boxes) if i % 6 < 2), 2: min(b for i, (_, b, *_) in enumerate(boxes) if i % 6 == 2)}
    assert got == {b: least[0] if i % 6 < 2 else least[2] if i % 6 == 2 else b for i, (_, b, *_) in enumerate(boxes)}
    assert links == [1]


def test_near_boxes_of_very_unequal_size(spark):
    rng = random.Random(12)
    boxes = rectangles(rng, 60, 6)
    near = lambda a, b: a[0] == b[0] and a[2] - 1.5 < b[4] and b[2] - 1.5 < a[4] and a[3] - 1.5 < b[5] and b[3] - 1.5 < a[5]
    root = {b[1]: b[1] for b in boxes}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(boxes, 2):
        if near(a, b):
            low, high = sorted((find(a[1]), find(b[1])))
            root[high] = low
    df = spark.createDataFrame(boxes, "page int, box_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_id: r.cluster for r in geometry.near_boxes(df, ["page"], 1.5).collect()}
    assert got == {i: find(i) for i in root} and len(set(got.values())) > 6


def test_violators_count_across_spans_in_bounded_windows(spark):
    """Few keys, many events at one time, negative and null times and keys: counts are those of the trailing seconds, and no window holds a key."""
    rng = random.Random(11)
    events = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(-40, 60)])) for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, k int, at long")
    for seconds in (0, 7, 30):
        trails = lambda a, b: a[1] == b[1] and (a[2] is None and b[2] is None or None not in (a[2], b[2]) and a[2] - seconds <= b[2] <= a[2])  # noqa: B023, E731
        want = {a[0]: n for a in events if (n := sum(trails(a, b) for b in events)) >= 5}
        found = workspace.violators(df, "k", "at", seconds, 5)
        assert found.columns == ["event_id", "k", "at", "violations"]
        assert {r.event_id: r.violations for r in found.collect()} == want
    assert "_span" in found._jdf.queryExecution().analyzed().toString()


def test_stored_sketches_are_merged(spark, tmp_path):
    """Written, read again and rolled up twice: as close to the exact answers as the sketches promise."""
    rows = spark.range(60000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("kind"), (F.col("id") * 7919 % 20011).alias("who"), (F.col("id") * 31 % 1000).cast("double").alias("v"))
    rollup = sketches.Rollup(levels={"day": F.col("day"), "kind": F.col("kind")}, counts={"n": None, "high": F.col("v") >= 500}, sums={"total": F.col("who")}, distinct={"people": F.col("who")}, spread={"v": F.col("v")})
    rollup.built(rows).write.parquet(str(tmp_path / "rollup"))
    stored = spark.read.parquet(str(tmp_path / "rollup"))
    by_kind = rollup.rolled_up(stored, ["kind"])
    whole = rollup.answers(rollup.rolled_up(by_kind, []), (0.1, 0.5)).first()
    assert (whole.n, whole.high, whole.total) == tuple(rows.agg(F.count("*"), F.count_if(F.col("v") >= 500), F.sum("who")).first())
    assert abs(whole.people - 20011) <= 0.05 * 20011 and abs(whole.v_p50 - 500) <= 30 and abs(whole.v_p10 - 100) <= 30
    exact = {r.kind: r.people for r in rows.groupBy("kind").agg(F.count_distinct("who").alias("people")).collect()}
    assert all(abs(r.people - exact[r.kind]) <= 0.05 * exact[r.kind] for r in rollup.answers(by_kind).collect())
    with pytest.raises(ValueError):
        rollup.rolled_up(stored, ["week"])


WORKBOOK = """<?xml version='1.0' encoding='utf-8'?><workbook><datasources><datasource name='orders' caption='Or&amp;ders' version='18.1'>
<connection class='federated'><named-connections><named-connection caption='f' name='n1'><connection class='csv' dbname='d' server='s'><relation name='inner' table='[t]' type='table' connection='n1'/></connection></named-connection></named-connections>
<relation name='outer' type='join'><columns><column name='a'/><column name='b' datatype='integer'/></columns></relation>
<metadata-records><metadata-record class='column'><remote-name>Sales</remote-name><local-name>[Sales]</local-name><parent-name>[t]</parent-name><local-type>real</local-type><aggregation>Sum</aggregation></metadata-record></metadata-records></connection>
<column name='[Sales]' datatype='real' role='measure' type='quantitative' ordinal='2'/>
<column name='[Plus]' datatype='real' role='measure'><calculation class='tableau' formula='[Sales] + 1'><table-calc type='Rows'/></calculation><aliases><alias key='1' value='one'/></aliases></column>
</datasource></datasources></workbook>"""


def test_workbook_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.twb").write_text(WORKBOOK, encoding="utf-8")
    (tmp_path / "sub" / "b.twb").write_text("<workbook><datasources/></workbook>", encoding="utf-8")
    (tmp_path / "broken.twb").write_text("<workbook><datasources><datasource", encoding="utf-8")
    (tmp_path / "other.txt").write_text("x")
    files = workbooks.workbook_files(spark, str(tmp_path))
    assert files.count() == 3
    sources = workbooks.datasources(files, "path")
    assert [(r.name, r.caption, r.version) for r in sources.collect()] == [("orders", "Or&ders", "18.1")]
    columns = workbooks.source_columns(sources, "path").orderBy("nth").collect()
    assert [(c.name, c.role, c.ordinal, c.formula, c.calculation_class, c.has_table_calc) for c in columns] == [("[Sales]", "measure", 2, None, None, False), ("[Plus]", "measure", None, "[Sales] + 1", "tableau", True)]
    assert [tuple(a) for a in columns[1].aliases] == [("1", "one")]
    assert sorted((r["class"] or "", r["name"] or "") for r in workbooks.connections(sources, "path").collect()) == [("", "n1"), ("csv", ""), ("federated", "")]
    assert sorted((r.name, r.table or "", r.type, tuple(r.columns)) for r in workbooks.relations(sources, "path").collect()) == [("inner", "[t]", "table", ()), ("outer", "", "join", ("a", "b"))]
    assert [tuple(r)[2:] for r in workbooks.metadata_records(sources, "path").collect()] == [("column", "Sales", "[Sales]", "[t]", "real", "Sum")]


def test_packed_workbooks(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.twbx", "w") as package:
        package.writestr("deep/er/other.twb", "<workbook/>")
        package.writestr("longer name.twb", "<workbook/>")
        package.writestr("book.TWB", WORKBOOK)
        package.writestr("Data/x.csv", "1")
    with zipfile.ZipFile(tmp_path / "none.twbx", "w") as package:
        package.writestr("x.csv", "1")
    (tmp_path / "broken.twbx").write_bytes(b"no zip")
    files = workbooks.packed_workbook_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.xml for r in files.collect()} == {"a.twbx": WORKBOOK, "none.twbx": None, "broken.twbx": None}
    assert [r.name for r in workbooks.datasources(files, "path").collect()] == ["orders"]


def test_prices(spark):
    sheet = [(0, "a", "big", 0.003, 0.015), (1, "A", "bigger", 0.015, 0.075), (2, "a", "", 0.001, 0.001), (3, "b", "xyz", 1.0, 1.0), (4, "b", "abc", 2.0, 2.0), (5, "local", "", 0.0, 0.0)]
    prices = spark.createDataFrame(sheet, "nth int, provider string, part string, in_per_1k double, out_per_1k double")
    calls = [("a", "The-BIG-one", 10000, 2000, "0.06"), ("a", "bigger", 1000, 500, "0.0525"), ("a", "other", 1000, 1000, "0.002"), ("b", "abcxyz", 1000, 0, "1"), ("a", "", 1000, 0, "0"), ("a", None, 1000, 0, "0"), ("c", "big", 9, 9, "0"), ("local", "m", 5, 5, "0")]
    got = spend.priced(spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(calls)], "i int, provider string, model string, input_tokens long, output_tokens long"), prices).orderBy("i").collect()
    assert [float(r.cost) for r in got] == [float(c[4]) for c in calls]


def test_elements_by_what_they_say(spark):
    """The known case: of two charts the one whose title is named; equal titles are told apart by the viewed page."""
    from lathework.operators import search

    rows = [(1, 1, "text", "Title Quarterly Review", "top-center", 0), (2, 1, "chart", "Q4 Revenue Revenue Performance Revenue Cost", "center", 1), (3, 2, "chart", "Headcount Chart Headcount Growth", "middle-left", 0)]
    rows += [(4, 2, "table", "Department Table Count", "top-right", 1), (5, 3, "shape", "Important note Bottom Callout", "bottom-right", 0), (6, 3, "text", "Slide 3 Title Quarterly Review", "top-center", 1), (7, 3, "text", None, "center", 2)]
    df = spark.createDataFrame(rows, "element_id long, page int, kind string, label string, place string, z int")
    first = lambda *a, **b: search.ranked_elements(df, *a, text_col="label", **b).orderBy(F.desc("confidence")).first()
    assert first("the headcount chart").element_id == 3
    assert first("the quarterly title", viewing=1).element_id == 1
    assert first("the quarterly title", viewing=3).element_id == 6
    assert first("anything", kinds=["table"]) is None
    assert search.ranked_elements(df, "this", viewing=1, selected=2, text_col="label").collect()[0].score == 1.0
