"""The analysis end to end: parsing quirks, resolution, findings, fixes, streaming."""

import re

import pytest
from pyspark.sql import functions as F

from varloom.config import COLOR_HINTS, AnalyzerConfig
from varloom.operators import editor, parse
from varloom.operators.index import by_usage
from varloom.plans.analyzer import Analyzer
from varloom.sources.files import files_from_table, read_files
from varloom.streaming.changes import DefinitionStream, replay

VARIABLES = ":root{--brand: #3498db; --alias: var(--brand);}"
SHEET = ".x{color: var(--brand); background: var(--brnd); font-size: 14px; border: 1px solid #ccc; margin: 3px; fill: var(--brand, #ccc)}"


def files(spark, **texts):
    return files_from_table(spark.createDataFrame([("/ws/" + p.replace("__", "."), t) for p, t in texts.items()], "path string, text string"))


def parsed(spark, source):
    f = files(spark, a__css=source)
    rules = parse.rules(f)
    r = [x["selector"] for x in rules.orderBy("rule_ord").collect()]
    d = [(x["property"], x["value"]) for x in parse.declarations(rules).orderBy("rule_ord", "decl_ord").collect()]
    return r, d, sorted(x["name"] for x in parse.definitions(f).collect())


@pytest.mark.parametrize(
    "source,rules,decls,names",
    [
        (":root{--gray-500: #fff; --c1color: #fff; --c1-color: red; --a: var(--b)}", [":root"], [("color", "#fff"), ("-color", "red"), ("--a", "var(--b)")], ["--c1-color", "--c1color", "--gray-500"]),
        (".a { color: red; .b { color: blue; } margin: 1px; }", ["color: red; .b"], [("color", "blue")], []),
        ("@media (x) { .c { color: red } .d{color:#123} }", [".c", ".d"], [("color", "red"), ("color", "#123")], []),
        (".f{background:url(data:image/png;base64,AA==)}", [".f"], [("background", "url(data:image/png")], []),
        ("/* --old: 1px; */ .b--m:hover{color:red;}", [".b--m:hover"], [("color", "red")], ["--old"]),
        ("--x: {a:b};", ["--x:"], [("a", "b")], []),
    ],
)
def test_parsing(spark, source, rules, decls, names):
    assert parsed(spark, source) == (rules, decls, names)


@pytest.mark.parametrize(
    "index,name,found,value,chain",
    [
        ({"a": "#fff"}, "a", True, "#fff", "a"), ({"a": "var(--b)", "b": "red"}, "a", True, "red", "ab"), ({"a": "1px var(--b)", "b": "var(--c)", "c": "2px"}, "a", True, "1px 2px", "abc"),
        ({"a": "var(--b) var(--c)", "b": "x", "c": "y"}, "a", True, "x var(--c)", "ab"), ({"a": "var(--b, red)", "b": "blue"}, "a", True, "var(--b, red)", "ab"), ({"a": "var(--m)"}, "a", True, "var(--m)", "am"),
        ({"z": "1"}, "a", False, None, "a"), ({"a": "var(--a)"}, "a", True, "var(--a)", "a"), ({"a": "var(--b)", "b": "var(--a)"}, "a", True, "var(--a)", "ab"),
        ({chr(97 + k): f"var(--{chr(98 + k)})" for k in range(11)} | {"l": "1px"}, "a", True, "var(--k)", "abcdefghij"),
    ],
)
def test_resolution(spark, index, name, found, value, chain):
    from varloom.operators.resolve import resolve

    table = spark.createDataFrame([("--" + k, v) for k, v in index.items()], "name string, value string")
    row = resolve(table, spark.createDataFrame([("--" + name,)], "name string")).first()
    assert (row["found"], row["resolved_value"], row["chain"]) == (found, value, ["--" + c for c in chain])


def analysis(spark):
    return Analyzer(spark).load(files(spark, variables__css=VARIABLES, a__css=SHEET))


def test_findings_and_report(spark):
    a = analysis(spark)
    rows = a.diagnostics.orderBy("path", "phase", "o0", "o1", "o2").collect()
    assert [(r["path"], r["kind"], r["severity"], r["var_name"] or r["value"], r["property"]) for r in rows] == [
        ("/ws/a.css", "variableNoDefinida", 0, "--brnd", None), ("/ws/a.css", "valorHardcoded", 1, "#ccc", "fill"), ("/ws/a.css", "valorHardcoded", 1, "14px", "font-size"),
    ]
    for r in rows:  # ranges hold what they mark
        assert SHEET[r["start_col"] : r["end_col"]] in ("var(--brnd)", "var(--brand, #ccc)", "14px")
    assert tuple(a.project_report.first()) == (3, 2, 1)
    report = a.file_report.first()
    assert (report["total"], report["errors"], report["warnings"], len(report["examples"])) == (3, 1, 2, 3)


def test_actions_and_fixes(spark):
    a = analysis(spark)
    acts = {(r["kind"], r["rank"]): r["new_text"] for r in a.code_actions.collect()}
    assert acts == {("variableNoDefinida", 1): "var(--brand", ("valorHardcoded", 1): "var(--brand)"}
    fixed = {r["path"]: r["text"] for r in a.fixed_files.collect()}
    assert fixed["/ws/a.css"] == SHEET.replace("var(--brnd)", "var(--brand)").replace("var(--brand, #ccc)", "var(--brand)")
    assert fixed["/ws/variables.css"] == VARIABLES
    assert a.autofix().project_report.first()["total_diagnostics"] == 1


def test_disabled_and_empty(spark):
    assert Analyzer(spark, AnalyzerConfig(enabled=False)).load(files(spark, a__css=SHEET)).diagnostics.count() == 0
    empty = spark.createDataFrame([], "path string, text string")
    assert tuple(Analyzer(spark).load(empty).project_report.first()) == (0, 0, 0)
    nulls = spark.createDataFrame([("/ws/n.css", None), (None, SHEET)], "path string, text string")
    assert Analyzer(spark).load(nulls).project_report.count() == 1


@pytest.mark.parametrize(
    "source,found",
    [
        ("<a style={{color:'red'}}/>", [(3, 24)]), ("<a style={s}/>", [(3, 12)]), ("<a style = { { a: {b:1} } } />", [(3, 27)]), ("<a style={c ? {a:1} : x}/>", [(3, 19)]),
        ('<a style="x"/>', []), ("<a barStyle={x}/>", []), ("<a style={{x", [(3, 12)]),
    ],
)
def test_inline_styles(spark, source, found):
    a = Analyzer(spark).load(files(spark, a__tsx=source))
    assert [(r["start_col"], r["end_col"]) for r in a.diagnostics.collect()] == found


def test_editor_queries(spark):
    f = files(spark, variables__css=VARIABLES, a__css=".x{\n color: var(--brand);\n color: \n background: var(--br\n}")
    a = Analyzer(spark).load(f)
    cursors = spark.createDataFrame([(1, "/ws/a.css", 1, 14), (2, "/ws/a.css", 2, 8), (3, "/ws/a.css", 3, 21), (4, "/ws/a.css", 0, 1), (5, "/ws/a.css", 1, 18)], "cursor_id int, path string, line int, col int")
    at = {r["cursor_id"]: (r["name"], r["start_col"], r["end_col"]) for r in editor.variable_at_cursor(editor.cursor_lines(cursors, f)).collect()}
    assert at == {1: ("--brand", 12, 19), 5: ("--brand", 12, 19)}
    done = {(r["cursor_id"], r["rank"]): (r["mode"], r["label"]) for r in a.completions(cursors).collect()}
    assert done[2, 1] == ("call", "var(--brand)") and done[3, 1] == ("name", "--brand") and not any(k[0] == 4 for k in done)
    assert {r["cursor_id"]: r["target_path"] for r in a.goto_definition(cursors).collect()} == {1: "/ws/variables.css", 3: None, 5: "/ws/variables.css"}  # --br is not defined
    assert "#3498db" in {r["cursor_id"]: r["markdown"] for r in a.hover(cursors).collect()}[1]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a+b.css").write_text(SHEET)
    (tmp_path / "x.txt").write_text("no")
    rows = read_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["lang"], r["text"]) for r in rows] == [(str(tmp_path / "sub dir" / "a+b.css"), "css", SHEET)]


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.css").write_text(".x{color: var(--gone)} /* é 😀 */")
    (tmp_path / "bad.css").write_bytes(b".x{color: var(--gone)}\xff")
    a = Analyzer(spark).load_path(str(tmp_path))
    assert [r["path"] for r in a.parse_errors.collect()] == [str(tmp_path / "bad.css")]
    assert tuple(a.project_report.first()) == (1, 2, 1)


def test_change_feed(spark, tmp_path):
    feed = [(1, "/a.css", "upsert", "a{--x: 1px;}"), (2, "/b.css", "upsert", "a{--x: 2px; --y: 3px;}"), (3, "/a.css", "delete", None), (4, "/c.css", "upsert", "a{--z: 4px;}")]
    schema = "seq long, path string, op string, text string"
    want = [("--x", "2px"), ("--y", "3px"), ("--z", "4px")]
    assert sorted((r["name"], r["value"]) for r in replay(spark.createDataFrame(feed, schema)).collect()) == want
    source, stream = str(tmp_path / "feed"), DefinitionStream(spark, str(tmp_path / "table"), str(tmp_path / "ckpt"))
    for part in (feed[:2], feed[2:], [(5, None, "reset", None), (6, "/d.css", "upsert", "a{--d: 1px;}")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream.start(spark.readStream.schema(schema).parquet(source), once=True).awaitTermination()
        if part is not feed[:2] and part[0][0] == 3:
            assert sorted((r["name"], r["value"]) for r in stream.index().collect()) == want
    assert [(r["name"], r["value"]) for r in stream.index().collect()] == [("--d", "1px")]


def test_registry_matches_its_sql():
    from varloom.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_stored_findings(spark, tmp_path):
    path = str(tmp_path / "findings")
    one = lambda text, name="a": Analyzer(spark).load(files(spark, **{f"{name}__css": text}))
    texts = {f"d{k}": f".x{{color: var(--m{k})}}" for k in range(80)}  # more documents than buckets
    every = Analyzer(spark).load(files(spark, **{f"{k}__css": t for k, t in texts.items()}))
    stored = lambda t: sorted((r["path"], r["var_name"]) for r in t.collect())
    all_of = sorted((f"/ws/{k}.css", f"--m{k[1:]}") for k in texts)
    assert stored(every.write_diagnostics(path)) == all_of
    assert stored(one(".x{color: inherit}", "d3").write_diagnostics(path)) == [r for r in all_of if r[0] != "/ws/d3.css"]
    again = stored(one(".x{color: var(--new)}", "d3").write_diagnostics(path))
    assert again == sorted([r for r in all_of if r[0] != "/ws/d3.css"] + [("/ws/d3.css", "--new")])


def test_actions_by_language(spark):
    a = Analyzer(spark).load(files(spark, variables__css=VARIABLES, a__sass=SHEET, b__scss=SHEET))
    assert {r["path"] for r in a.diagnostics.collect()} == {"/ws/a.sass", "/ws/b.scss"}
    assert {r["path"] for r in a.code_actions.collect()} == {"/ws/b.scss"}


def test_similar_names_by_brute_force(spark):
    import random

    from varloom.operators.suggest import similar_names

    rng = random.Random(5)
    word = lambda: "--" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    # names around the length from which they meet by segments: two thirds are edits of a few long ones
    stems = ["--" + "".join(rng.choice("abcd") for _ in range(n)) for n in (36, 38, 39, 41, 60)]

    def edited():
        name = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(2, len(name))
            name[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "f"])
        return "".join(name)

    known, asked = sorted({word() for _ in range(120)} | {edited() for _ in range(90)}), sorted({word() for _ in range(60)} | {edited() for _ in range(40)} | {"--zzzzzzzz", "--"})
    index = spark.createDataFrame([(n, 0, "/p", k) for k, n in enumerate(known)], "name string, pattern_ord int, path string, offset int")
    got = {}
    for r in similar_names(spark.createDataFrame([(n,) for n in asked * 2], "name string"), index).collect():
        got.setdefault(r["var_name"], []).append((r["rank"], r["candidate"], round(r["similarity"], 9)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for n in asked:
        scored = [(-(max(len(n), len(c)) - distance(n, c)) / max(len(n), len(c)), k, c) for k, c in enumerate(known)]
        want = [(i + 1, c, round(-s, 9)) for i, (s, _, c) in enumerate(sorted(x for x in scored if x[0] < -0.5)[:3])]
        assert sorted(got.get(n, [])) == want


def test_variables_for_values_by_brute_force(spark):
    import math
    import random

    from varloom.operators.suggest import variables_for_values

    rng = random.Random(6)
    shade = lambda: f"#{rng.choice((10, 200, 250)) + rng.randint(0, 5):02x}{rng.randint(0, 255):02x}{rng.choice((0, 128)):02x}"
    known = [(f"--v{k}", rng.choice(["#FF0000", "red", "#f00", shade(), "4px", shade()])) for k in range(150)]
    asked = ["red", "#ff0000", "#FF0000", "4PX", "#00ff00", *[shade() for _ in range(40)]]
    index = spark.createDataFrame([(n, v, v != "4px", 0, 0, "/p", k) for k, (n, v) in enumerate(known)], "name string, value string, is_color boolean, use_count long, pattern_ord int, path string, offset int")
    resolved = spark.createDataFrame([(n, v, v) for n, v in known], "name string, value string, resolved_value string")
    got = {}
    for r in variables_for_values(spark.createDataFrame([(v,) for v in asked], "value string"), index, resolved).collect():
        got.setdefault(r["value"], []).append((r["rank"], r["candidate"], round(r["score"], 6)))
    rgb = lambda v: {"red": (255, 0, 0), "#f00": (255, 0, 0)}.get(v) or (tuple(int(v[i : i + 2], 16) for i in (1, 3, 5)) if len(v) == 7 else None)
    for v in asked:
        scored = []
        for k, (n, t) in enumerate(known):
            if t.lower() == v.lower():
                scored.append((-100.0, k, n))
            elif rgb(t.lower()) and rgb(v.lower()) and (s := 50 - math.dist(rgb(t.lower()), rgb(v.lower())) / 5) > 10:
                scored.append((-s, k, n))
        assert sorted(got.get(v, [])) == [(i + 1, n, round(-s, 6)) for i, (s, _, n) in enumerate(sorted(scored)[:3])]


def test_editor_rankings_against_brute_force(spark):
    names = ["--red", "--dark-red", "--a--red", "--redder", "--RE-d", "--blue-red-red", "--x", "--dark", "--da-", "--zz-top", "--zz-tap", "--zz-tip", "--zz-tup", "--" + "lo" * 14 + "-q", "--x" + "lo" * 20 + "red"]
    rows = [(n, "#fff", "/ws/v.css", 0, 0, k, True, 0, (k * 7) % 3) for k, n in enumerate(names)]
    known = spark.createDataFrame(rows, "name string, value string, path string, line int, col int, offset int, is_color boolean, pattern_ord int, use_count bigint")

    ranked = [r["name"] for r in by_usage(known).orderBy("rank").collect()]
    assert ranked == [r[0] for r in sorted(rows, key=lambda r: (-r[8], r[5]))]
    assert by_usage(known.where("false")).count() == 0

    words = lambda n: re.sub(r"^(.*?)--", "", n.lower(), count=1).split("-")
    asked = ["--red", "--dark-redd", "--zz-", "--q", "--dark--", "--re-re-d", "--nothing-here", "--" + "lo" * 14, "--ol" + "ol" * 12 + "o", "--" + "lo" * 30]
    want = {}
    for a in asked:
        points = [(10 * sum(w in v or v in w for w in words(a) if len(w) > 1 for v in words(n)) + 5 * n.lower().startswith(a.lower()[:5]), k, n) for k, n in enumerate(names)]
        for rank, (p, _, n) in enumerate(sorted((x for x in points if x[0]), key=lambda x: (-x[0], x[1]))[:3], 1):
            want[a, rank] = (n, p)
    got = editor.hover_similar(spark.createDataFrame([(a,) for a in asked + asked[:2]], "name string"), known)
    assert {(r["name"], r["rank"]): (r["candidate"], r["points"]) for r in got.collect()} == want

    contexts = [(1, "name", "color", ""), (2, "name", None, "RED"), (3, "call", "color", ""), (4, "name", "fill", "z-t"), (5, "name", None, "d"), (6, "name", None, "none-such"), (7, "name", None, "RED")]
    resolved = known.select("name", "value", F.col("value").alias("resolved_value"))
    got = editor.completions(spark.createDataFrame(contexts, "cursor_id int, mode string, property string, filter string"), known, resolved, AnalyzerConfig()).collect()
    keywords = AnalyzerConfig().keywords
    for cursor, mode, prop, part in contexts:
        colours = 40 * any(h in (prop or "") for h in COLOR_HINTS)
        scored = [(r[8] + 50 * sum(w.lower() in r[0].lower() for w in keywords.get(prop, [])) + (30 if part else 0) + colours, -r[5], r[0]) for r in rows if part.lower() in r[0].lower()]
        best = [(s, n) for s, _, n in sorted(scored, reverse=True)][: 5 if mode == "call" else 50]
        assert [(r["relevance"], r["name"]) for r in sorted((r for r in got if r["cursor_id"] == cursor), key=lambda r: r["rank"])] == best


def test_very_long_names(spark):
    from varloom.operators.suggest import similar_names

    long = "--" + "ab-c" * 1250
    known = spark.createDataFrame([(n, 0, "/p", k) for k, n in enumerate([long, long[:-7] + "x", "--short", long + "zz"])], "name string, pattern_ord int, path string, offset int")
    asked = spark.createDataFrame([(long[:3000] + "q" + long[3000:],), ("--shart",)], "name string")
    assert sorted((len(r["var_name"]), r["rank"], len(r["candidate"])) for r in similar_names(asked, known).collect()) == [(7, 1, 7), (5003, 1, 5002), (5003, 2, 5004), (5003, 3, 4996)]
    found = editor.hover_similar(asked.unionByName(spark.createDataFrame([("--" + "w" * 5000,)], "name string")), known.unionByName(spark.createDataFrame([("--x" + "w" * 5100, 0, "/p", 9)], known.schema)))
    best = {(r["name"][:5], r["rank"]): (len(r["candidate"]), r["points"]) for r in found.collect()}
    assert best["--www", 1] == (5103, 10)


def test_hover_with_frequent_words(spark, monkeypatch):
    import random

    from varloom.operators import editor

    rng = random.Random(12)
    words = ["ab", "a", "abc", "xy", "y", "zz", "q"]
    known = sorted({"--" + "-".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(80)})
    asked = sorted({"--" + "-".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(25)})
    index = spark.createDataFrame([(n, 0, "/v.css", k) for k, n in enumerate(known)], "name string, pattern_ord int, path string, offset int")
    names = spark.createDataFrame([(n,) for n in asked], "name string")
    for frequent in (3, 100):
        monkeypatch.setattr(editor, "FREQUENT", frequent)
        got = {}
        for r in editor.hover_similar(names, index).orderBy("name", "rank").collect():
            got.setdefault(r["name"], []).append((r["candidate"], r["points"]))
        for name in asked:
            def points(c, name=name):
                mine = [w for w in name[2:].split("-") if len(w) >= 2]
                return 10 * sum(w in v or v in w for w in mine for v in c[2:].split("-")) + 5 * c.startswith(name[:5])

            best = sorted(((c, points(c)) for c in known if points(c)), key=lambda x: (-x[1], known.index(x[0])))[:3]
            assert got.get(name, []) == best, name


def test_actions_parse_documents_once(spark):
    files = spark.createDataFrame([("/ws/variables.css", ":root{--ab: red;}"), ("/ws/a.css", "a{color: var(--ac)} b{color: red}")], "path string, text string")
    actions = Analyzer(spark).load(files).code_actions
    assert "posexplode" not in actions._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["title"], r["new_text"]) for r in actions.collect()} == {("¿Quisiste decir var(--ab)?", "var(--ab"), ("Reemplazar con var(--ab)", "var(--ab)")}


def test_completions_meet_by_whole_filters(spark, monkeypatch):
    import random

    rng = random.Random(16)
    names = sorted({"--" + "-".join(rng.choice(["part", "pa", "Color", "bg", "font", "1", "12", "123"]) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    rows = [(n, "#fff", "/ws/v.css", 0, 0, k, k % 3 == 0, 0, k % 2) for k, n in enumerate(names)]
    known = spark.createDataFrame(rows, "name string, value string, path string, line int, col int, offset int, is_color boolean, pattern_ord int, use_count bigint")
    resolved = known.select("name", "value", F.col("value").alias("resolved_value"))
    parts = sorted({n[i:j] for n in rng.sample(names, 12) for i in (0, 2, 3, 5) for j in (3, 4, 5, 7, 9, 20) if i < j} | {"", "p", "PA", "par", "part-1x", "12", "-"})
    contexts = [(k, rng.choice(["name", "call"]), rng.choice([None, "color", "background", "font-size"]), p) for k, p in enumerate(parts * 2)]
    keywords = AnalyzerConfig().keywords
    monkeypatch.setattr(editor, "COMPLETIONS_IN_VAR", 4)
    monkeypatch.setattr(editor, "COMPLETIONS_BEFORE_VAR", 2)
    for head in (4, 64):
        monkeypatch.setattr(editor, "HEAD", head)
        got = {}
        for r in editor.completions(spark.createDataFrame(contexts, "cursor_id int, mode string, property string, filter string"), known, resolved, AnalyzerConfig()).orderBy("cursor_id", "rank").collect():
            got.setdefault(r["cursor_id"], []).append((r["relevance"], r["name"]))
        for cursor, mode, prop, part in contexts:
            colours = 40 * any(h in (prop or "") for h in COLOR_HINTS)
            scored = [(-(r[8] + 50 * sum(w in r[0].lower() for w in keywords.get(prop, [])) + (30 if part else 0) + (colours if r[6] else 0)), r[5], r[0]) for r in rows if part.lower() in r[0].lower()]
            assert got.get(cursor, []) == [(-s, n) for s, _, n in sorted(scored)[: 2 if mode == "call" else 4]], (cursor, mode, prop, part)


def test_completions_parse_documents_once(spark):
    files = spark.createDataFrame([("/ws/variables.css", ":root{--ab: red; --ac: var(--ab);}"), ("/ws/a.css", "a{color: var(--a)}")], "path string, text string")
    cursors = spark.createDataFrame([(1, "/ws/a.css", 0, 16)], "cursor_id int, path string, line int, col int")
    found = Analyzer(spark).load(files).completions(cursors)
    # neither definitions nor the cursors' lines are made again by what follows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "split(" not in plan
    assert [r["name"] for r in found.orderBy("rank").collect()] == ["--ab", "--ac"]


def test_values_outside_the_colour_cube(spark):
    import math
    import random

    from varloom.operators.suggest import variables_for_values

    rng = random.Random(22)
    shade = lambda top: tuple(rng.randrange(top) for _ in range(3))
    known = [(f"--k{k}", shade(rng.choice([20, 90, 256]))) for k in range(400)] + [(f"--o{k}", (280 + k, 3, 250)) for k in range(3)]
    asked = [shade(300) for _ in range(60)] + [(299, 5, 7), (270, 260, 258), (900, 0, 0), (299, 255, 7)]
    text = lambda c: f"rgb({c[0]}, {c[1]}, {c[2]})"
    for some in (known, known[:4], known[:400]):
        index = spark.createDataFrame([(n, text(c), "/ws/v.css", 0, 0, k, True, 0, 0) for k, (n, c) in enumerate(some)], "name string, value string, path string, line int, col int, offset int, is_color boolean, pattern_ord int, use_count bigint")
        resolved = index.select("name", "value", F.col("value").alias("resolved_value"))
        found = variables_for_values(spark.createDataFrame([(text(c),) for c in asked], "value string"), index, resolved)
        got = {}
        for r in found.orderBy("value", "rank").collect():
            got.setdefault(r["value"], []).append((r["candidate"], round(r["score"], 6)))
        for c in asked:
            scored = sorted((-100.0 if c == o else math.dist(c, o) / 5 - 50, k, n) for k, (n, o) in enumerate(some))
            assert got.get(text(c), []) == [(n, round(-s, 6)) for s, _, n in scored if s < -10][:3], c


def test_values_read_tables_written_once(spark):
    from varloom.operators.suggest import variables_for_values

    files = spark.createDataFrame([("/ws/variables.css", ":root{--ab: red; --ac: var(--ab);}")], "path string, text string")
    a = Analyzer(spark).load(files)
    found = variables_for_values(spark.createDataFrame([("red",), ("#f00",)], "value string"), *a.kept)
    # neither the documents nor the chains of aliases are made again by what the branches read
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "var(" not in plan
    assert {(r["value"], r["rank"], r["candidate"]) for r in found.collect()} == {("red", 1, "--ab"), ("red", 2, "--ac"), ("#f00", 1, "--ab")}


def test_globs_of_a_fixed_text(spark):
    from varloom.functions.globs import glob_regex, matches_any

    paths = ["/ws/variables.css", "/ws/variablesxcss", "C:\\ws\\dist\\a.css", "/ws/a[1].css", "/ws/a1.css", "/ws/ab.min.css", "/a/bcss", "/ac/b", "x"]
    globs = ["**/variables.css", "**/dist/**", "**/a[1].css", "**/*.min.css", "b?css", "a*/b", "**/*", "*"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", *[matches_any(F.col("path"), [g]).alias(g) for g in globs])
    assert "contains(" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in got.collect():
        assert [r[g] for g in globs] == [re.search(glob_regex(g), r["path"].replace("\\", "/")) is not None for g in globs], r["path"]
