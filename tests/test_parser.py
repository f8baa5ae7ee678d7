"""The parser against plain regular expressions, and its time on growing documents."""

import random
import re
import time

from pyspark.sql import functions as F

from varloom.functions import text
from varloom.functions.globs import glob_regex, matches_any
from varloom.operators import diagnostics as diag
from varloom.operators import parse
from varloom.config import AnalyzerConfig
from varloom.plans.analyzer import Analyzer
from varloom.sources.files import files_from_table


def at(source, offset):
    before = source[:offset]
    return before.count("\n"), len(before) - before.rfind("\n") - 1


def table(spark, texts, ext="css"):
    return files_from_table(spark.createDataFrame([(f"/ws/{k:03d}.{ext}", t) for k, t in enumerate(texts)], "path string, text string"))


def expected(source):
    """Rules, declarations and uses of one document by the plain patterns."""
    blank = re.sub(r"/\*[\s\S]*?\*/", lambda m: " " * len(m[0]), source)
    rules, decls, uses = [], [], []
    for r, rule in enumerate(re.finditer(r"([^{}]+)\{([^{}]*)\}", blank)):
        rules.append((r, rule[1].strip(), rule[2], *at(source, rule.start())))
        for d, decl in enumerate(re.finditer(r"([a-zA-Z-]+)\s*:\s*([^;]+);?", rule[2])):
            prop = rule.start(2) + decl.start()
            raw = decl[2]
            value = re.sub(r";\Z", "", re.sub("(?i)!important", "", raw)).strip()
            begin = prop + decl[0].index(raw) + len(raw) - len(raw.lstrip())
            start, end = at(source, begin), at(source, begin + len(value))
            line, col = at(source, prop)
            if value and "\n" not in value and start[0] != line:
                found = source.split("\n")[line].find(value, col + len(decl[1]))
                if found >= 0:
                    start, end = (line, found), (line, found + len(value))
            decls.append((r, d, decl[1], value, line, col, *start, *end))
            for u, use in enumerate(re.finditer(r"var\(\s*(--[\w-]+)\s*(?:,\s*([^)]+))?\s*\)", value)):
                place = []
                for offset in (use.start(), use.end()):
                    before = value[:offset]
                    n = before.count("\n")
                    base = at(source, begin)
                    place += [base[0] + n, base[1] + offset if not n else len(before) - before.rfind("\n") - 1]
                uses.append((r, d, u, use[1], (use[2] or "").strip() or None, *place))
    return rules, decls, uses


def test_parser_against_plain_patterns(spark):
    rng = random.Random(8)
    words = ["a", "-x:", "color:", "color", " : ", "var(--b)", "var( --c , #fff )", "var(--d,\n 1px)", "{", "}", "{", "}", ";", ";", "\n", "\n", " ", "/* {;} */", "/* x: y;\n }*/", "/*", "*/", "!important", "é", "😀", ":", "--v:", "red", "(", ")"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(250)]
    texts += ["", "{}", "a{}", "a{b:c}", "a{b:\n:}", "a:\n{x:\n /* red */ red;}", ".a{" + "x: y;\n" * 200 + "}", "a{x:1}\n" * 150]
    found = table(spark, texts)
    rules = parse.rules(found)
    decls = parse.declarations(rules)
    got = {k: ([], [], []) for k in range(len(texts))}
    key = lambda r: int(r["path"][4:7])
    for r in rules.orderBy("path", "rule_ord").collect():
        got[key(r)][0].append((r["rule_ord"], r["selector"], r["content"], r["rule_line"], r["rule_col"]))
    spans = ["start_line", "start_col", "end_line", "end_col"]
    for r in decls.orderBy("path", "rule_ord", "decl_ord").collect():
        got[key(r)][1].append(tuple(r[c] for c in ("rule_ord", "decl_ord", "property", "value", "prop_line", "prop_col", *spans)))
    for r in parse.var_uses(decls).orderBy("path", "rule_ord", "decl_ord", "use_ord").collect():
        got[key(r)][2].append(tuple(r[c] for c in ("rule_ord", "decl_ord", "use_ord", "name", "fallback", *spans)))
    for k, source in enumerate(texts):
        assert got[k] == expected(source), repr(source)


def test_matches_and_positions(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab\nxé😀,") for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.matches(F.col("t"), "[ab]+x?").alias("m"), text.split_at(F.col("t"), ",").alias("s"))
    for r in df.collect():
        assert [(m["offset"], m["line"], m["col"], m["match"]) for m in r["m"]] == [(m.start(), *at(r["t"], m.start()), m[0]) for m in re.finditer("[ab]+x?", r["t"])]
        offset = 0
        for part in r["s"]:
            assert (part["at"]["offset"], part["at"]["line"], part["at"]["col"]) == (offset, *at(r["t"], offset))
            offset += len(part["text"]) + 1


def test_inline_objects_against_a_scan(spark):
    rng = random.Random(10)
    words = ["style={{", "style = {\n {", "{", "}", "}}", "x", "\n", "style={", "é", " "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = {}
    for r in diag.inline_objects(table(spark, texts, "tsx"), AnalyzerConfig()).orderBy("path", "ord").collect():
        got.setdefault(int(r["path"][4:7]), []).append(((r["start_line"], r["start_col"]), (r["end_line"], r["end_col"])))
    for k, source in enumerate(texts):
        want = []
        for m in re.finditer(r"style\s*=\s*\{\s*\{", source):
            depth, end = 2, m.end()
            while end < len(source) and depth:
                depth += {"{": 1, "}": -1}.get(source[end], 0)
                end += 1
            want.append((at(source, m.start()), at(source, end)))
        assert got.get(k, []) == want, repr(source)


def test_twice_the_rules_take_about_twice_the_time(spark):
    def sheet(n):
        return "/* head { */ :root{--a: red;}\n" + "".join(f".c{k} > a {{\n  color: var(--v{k}, #abc);\n  font-size: {k}px\n}}\n" for k in range(n))

    def seconds(n):
        files = table(spark, [sheet(n)])
        began = time.time()
        assert Analyzer(spark).load(files).diagnostics.count() == 3 * n
        return time.time() - began

    seconds(100)  # compiled
    small, large = seconds(8000), seconds(32000)
    assert large < 8 * small


def test_globs_without_their_ends(spark):
    globs = ["**/node_modules/**", "**/*", "**/*.min.css", "**/variables.css", "*.css", "a/**", "**", "dist/*", "**?x", "src/**/*.css"]
    paths = ["/ws/node_modules/x.css", "node_modules/x", "/a.min.css", "a.min.css", "/ws/variables.css", "variables.css", "b.css", "a/", "a", "", "dist/", "x", "/src/p/q.css", "src/q.css", "a\\b.css"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", *[matches_any(F.col("p"), [g]).alias(f"g{k}") for k, g in enumerate(globs)]).collect()
    for r in rows:
        assert [r[f"g{k}"] for k in range(len(globs))] == [bool(re.search(glob_regex(g), r["p"].replace("\\", "/"))) for g in globs], r["p"]


def test_pieces_of_a_text(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("a:\nxé;;") for _ in range(rng.choice([0, 1, 40, 90, 2000]))) for _ in range(40)] + [";" * (text.PIECE - 1), ";" * text.PIECE, "a:;" * 5000]
    counted = lambda p: F.contains(p, F.lit(":"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.pieces(F.col("t"), F.replace("t", F.lit(":"), F.lit("!")), ";", counted).alias("p")).collect()
    for r in rows:
        before = ""
        for piece in r["p"]:
            assert piece["text"].count(";") < text.PIECE and piece["masked"] == piece["text"].replace(":", "!")
            assert (piece["at"]["offset"], piece["at"]["line"], piece["at"]["col"]) == (len(before), *at(r["t"], len(before)))
            assert piece["first"] == sum(":" in p for p in before.split(";"))
            before += piece["text"] + ";"
        assert before == r["t"] + ";"


def test_parts_are_computed_once(spark):
    # no filter computes the parts a second time
    decls = parse.declarations(parse.rules(table(spark, ["a{b: c}"])))
    plan = decls._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and "Filter ((size(" not in plan


def test_only_what_can_call_is_placed(spark):
    """Uses and definitions of the narrowed parse are those of the whole one, and no filter makes a call's array again."""
    texts = ["a{x:1;y:var(--b);z:2}b{--c:1;x:2}c{--d:var(--e,red)}", "a{x:va!importantr(--f);y:3}b{q:1}", "a{" + "x:1;" * 70 + "y:var(--g)}" + "b{x:2}" * 40 + "c{--h:1}", "a{x:\n !IMPORTANT}b{y: \u3000;z:\u00a0 \n}"]
    a = Analyzer(spark).load(table(spark, texts))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(a.uses) == rows(parse.var_uses(a.declarations)) and a.uses.count() == 4
    assert rows(a.rule_definitions) == rows(parse.rule_definitions(a.declarations)) and a.rule_definitions.count() == 3
    # an inner explode of calls got a filter on the array's size, which made the array again
    plan = a.uses._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and not re.search(r"Filter \(?\(size\(", plan)


def test_no_filter_makes_an_exploded_array_again(spark):
    a = Analyzer(spark).load(table(spark, [":root{--a: 1px;}", "a{color:red;fill:var(--a, #fff)}"]))
    for found in (a.diagnostics, a.definitions, a.uses, parse.document_uses(a.files), diag.hardcoded_values(a.declarations, AnalyzerConfig())):
        assert not re.search(r"Filter \(+size\(", found._jdf.queryExecution().optimizedPlan().toString())
