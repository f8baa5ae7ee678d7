"""Golden cases of values, colours, globs and text recipes."""

import re

import pytest
from pyspark.sql import functions as F

from varloom.config import AnalyzerConfig
from varloom.functions import color, globs, text, values


def column(spark, items, *columns):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "k int, v string").select("k", *columns).orderBy("k").collect()
    return [tuple(r)[1:] if len(r) > 2 else r[1] for r in rows]


def test_var_calls(spark):
    cases = {
        "var(--color-primary)": [("--color-primary", None)],
        "var(--color, #fff)": [("--color", "#fff")],
        "var(--color, rgb(0, 0, 0))": [("--color", "rgb(0, 0, 0")],
        "var(--primary, var(--secondary))": [("--primary", "var(--secondary")],
        "linear-gradient(var(--start), var(--end))": [("--start", None), ("--end", None)],
        "var(--x , a )": [("--x", "a")],
        "var(--x, )": [("--x", None)],
        "var(--x,)": [],
        "VAR(--x)": [],
        "var(--é)": [],
    }
    got = column(spark, cases, values.var_calls(F.col("v")))
    assert [[(m["name"], m["fallback"]) for m in row] for row in got] == list(cases.values())


def test_hardcoded(spark):
    yes = ["#fff", "#ffffff", "#00ff00", "rgb(255, 0, 0)", "rgba(0, 0, 0, 0.5)", "16px", "1.5rem", "50%", "red", " Tomato ", "rgb(0, 0, 0"]
    no = ["var(--size)", "calc(var(--x) + 10px)", "1.5", "0", "1px solid #ccc", "10px 20px", "solid", "calc(1px + 2px)"]
    assert column(spark, yes + no, values.is_hardcoded(F.col("v"))) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    "value,want",
    [
        ("#fff", (255, 255, 255, 1.0, "#ffffff")), ("#fff0", (255, 255, 255, 0.0, "#ffffff00")), ("rgba(0, 0, 0, 0.5)", (0, 0, 0, 0.5, "#00000080")),
        ("hsl(120, 100%, 50%)", (0, 255, 0, 1.0, "#00ff00")), ("hsl(210, 50%, 40%)", (51, 102, 153, 1.0, "#336699")), ("hsl(360, 100%, 50%)", (0, 0, 0, 1.0, "#000000")),
        ("transparent", (0, 0, 0, 0.0, "#00000000")), ("#f00", (255, 0, 0, 1.0, "#ff0000")), ("rgb(128, 64, 32)", (128, 64, 32, 1.0, "#804020")), ("rgb(1 2 3 / 50%)", (1, 2, 3, 0.5, "#01020380")),
        ("rgb(10%, 0, 0)", None), ("#12345", None), (" rgb(0,0,0) ", None),
    ],
)
def test_parse_color(spark, value, want):
    c = column(spark, [value], color.parse_color(F.col("v")))[0]
    assert (c and (c["r"], c["g"], c["b"], c["a"], c["hex"])) == want


def test_is_color(spark):
    cases = ["#fff", "#ffffff00", "hsla(120, 100%, 50%, 0.5)", "red", " rgb(0,0,0) ", "notacolor", "#ff", "constructor"]
    assert column(spark, cases, color.is_color(F.col("v"))) == [True] * 5 + [False] * 3
    assert len(color.NAMED) == 149


def test_property_gate(spark):
    yes, no = ["color", "font-size", "background-image", "color-scheme", "border-color"], ["margin", "margin-top", "border-top-color", "font-weight", "width", "Color"]
    assert column(spark, yes + no, values.property_checked(F.col("v"), AnalyzerConfig())) == [True] * 5 + [False] * 6


def test_paths(spark):
    assert column(spark, ["styles.css", "a/styles.scss", "x.sass", "/b/styles.less", "script.js", ".css"], globs.is_style_file(F.col("v"))) == [True, True, True, True, False, False]
    assert column(spark, ["/a/x.min.css", "/a/x.min.css.map", "variables.css", "/w/variables.css"], globs.matches_any(F.col("v"), ["**/*.min.css"]), globs.matches_any(F.col("v"), ["**/variables.css"])) == [(True, False), (True, False), (False, False), (False, True)]


def test_positions(spark):
    t = "linea1\nlinea2\nlinea3"
    assert column(spark, [t], text.line_of(F.col("v"), F.lit(7)), text.column_of(F.col("v"), F.lit(7)), text.offset_of(F.col("v"), F.lit(1), F.lit(0)), text.line_text(F.col("v"), F.lit(9))) == [(1, 0, 7, "")]


def test_match_offsets_equal_finditer(spark):
    pattern = r"var\(\s*(--[\w-]+)\s*(?:,\s*([^)]+))?\s*\)"
    import random

    rng = random.Random(5)
    cases = ["".join(rng.choice(["var(", "--a", ")", ",", " ", "x", "var(--a)"]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    got = column(spark, cases, text.matches(F.col("v"), pattern))
    assert [[(m["offset"], m["match"]) for m in row] for row in got] == [[(m.start(), m[0]) for m in re.finditer(pattern, c, re.ASCII)] for c in cases]


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "v string").select(color.parse_color(F.col("v")).alias("c"), values.is_hardcoded(F.col("v")).alias("h"), values.clean_value(F.col("v")).alias("x")).first()
    assert tuple(row) == (None, None, None)


def test_sql_functions(spark):
    from varloom.functions.sql import register_functions

    register_functions(spark)
    assert tuple(spark.sql("SELECT css_is_color(' Red '), css_is_hardcoded('12px'), css_first_var('x var( --a , b)'), css_similarity('--brnd', '--brand')").first()) == (True, True, "--a", 6 / 7)


def test_nearest_name_without_an_interpreted_loop(spark):
    """The distance is bounded below 50, the first of equals wins, and no lambda runs over the names."""
    rows = [(0, 255, 255), (0, 254, 255), (128, 128, 128), (255, 255, 255), (40, 90, 20), (60, 60, 120), (200, 10, 90), (17, 3, 200)]
    df = spark.createDataFrame([(r,) for r in rows], "c struct<r:int,g:int,b:int>").select("c", color.nearest_name(F.col("c")).alias("name"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    codes = [(n, tuple(int(x[i : i + 2], 16) for i in (1, 3, 5))) for n, x in color.NAMED.items() if n != "transparent"]
    for c, name in df.collect():
        square, _, best = min((sum((a - b) ** 2 for a, b in zip(c, code, strict=True)), k, n) for k, (n, code) in enumerate(codes))
        assert name == (best if square < 2500 else None)
