"""Functions against plain Python and known cases."""

import colorsys
import random

from lathework.functions import colours, findings, prompts
from lathework.operators import graphs
from pyspark.sql import functions as F


def plain_colour(value, lum_mod, lum_off, shade, tint, alpha):
    r, g, b = (int(value[i : i + 2], 16) / 255 for i in (1, 3, 5))
    h, light, s = colorsys.rgb_to_hls(r, g, b)
    light = light * (lum_mod if lum_mod is not None else 100000) / 100000 + (lum_off or 0) / 100000
    out = []
    for c in colorsys.hls_to_rgb(h, max(0.0, min(1.0, light)), s):
        c *= 1 if shade is None else shade / 100000
        c = 1 - (1 - c) * (1 if tint is None else tint / 100000)
        a = 1 if alpha is None else alpha / 100000
        out.append(max(0, min(255, c * a + 1 - a)) * 255)
    return out


def test_modified_colours(spark):
    rng = random.Random(0)
    some = lambda: rng.choice([None, rng.randrange(0, 100001, 5000)])
    rows = [(f"#{rng.randrange(1 << 24):06X}", some(), some(), some(), some(), some()) for _ in range(300)]
    df = spark.createDataFrame(rows, "c string, m int, o int, s int, t int, a int")
    got = df.select(colours.modified(*(F.col(c) for c in "cmosta"))).collect()
    for row, (hexed,) in zip(rows, got, strict=True):
        assert all(abs(int(hexed[i : i + 2], 16) - want) <= 0.5 + 1e-6 for i, want in zip((1, 3, 5), plain_colour(*row), strict=True)), row
    odd = spark.createDataFrame([("#FF112233",), ("abc",), (None,), ("scheme:accent",), ("scheme:none",)], "c string")
    found = [r[0] for r in odd.select(colours.modified(colours.named(F.col("c"), {"accent": "#0a0B0c"}))).collect()]
    assert found == ["#112233", "#888888", "#888888", "#0A0B0C", "#888888"]


def test_routed_prompts(spark):
    cases = {"Make the title bold": "static_plan", "Match the style of the other slide": "iterative_plan", "Draw one bar per region": "scripted_plan", "Update the deck.": "iterative_plan", None: "iterative_plan"}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select(prompts.routed(F.col("p")).alias("r")).select("r.*").collect()
    assert [r["mode"] for r in got] == list(cases.values()) and got[3]["confidence"] == 0.4


def test_findings(spark):
    access, other = "AKIA" + "Q7" * 8, "a1/B" * 10
    docs = spark.createDataFrame([(1, f"first\nkey {access} and\nthen {other} end"), (2, f"only {other} end"), (3, None), (4, "x\n\npassword" + " = 'longenough'\npassword" + " = 'others1'")], "doc_id long, text string")
    got = sorted(tuple(r) for r in findings.findings(docs).collect())
    assert got[:2] == [(1, "aws_access_key", 2, "key [REDACTED-20] and"), (1, "aws_secret", 3, "then [REDACTED-40] end")]
    assert [r[:2] for r in got[2:]] == [(4, "password_assign")] * 2
    clean = dict(docs.select("doc_id", findings.redacted(F.col("text"))).collect())
    assert clean[1] == "first\nkey [REDACTED-aws_access_key] and\nthen [REDACTED-aws_secret] end" and other in clean[2] and clean[3] is None


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("b", "leaf")], "source string, target string")
    roots = spark.createDataFrame([("a",), ("a",)], "node string")
    assert sorted(tuple(r) for r in graphs.reachable(edges, roots).collect()) == [("a", 0), ("b", 1), ("c", 2), ("leaf", 2)]
