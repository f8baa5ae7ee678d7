"""Style sheets to rules, declarations, uses and definitions, with document positions.

Every step is a projection or an explode over one document: no shuffle. A
document is cut at its marks, in pieces of a bounded number of parts where it has
many; parts become rows at once, so that generated code takes them apart. No row
carries the text of a whole document of many parts. Explodes are outer ones with
a condition on the row: the optimiser gives an inner one a filter on the array's
size, which makes the array, and all that it is made of, a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.color import is_color
from varloom.functions.text import BLANKS, WS, extent, js_trim, let, matches, moved, pieces, place, upto
from varloom.functions.values import VAR, clean_value, definition_name, is_definition, without_important

COMMENT = r"/\*[\s\S]*?\*/"
#: A declaration up to the end of its part between semicolons; the look-behind and the possessive class match what the plain pattern matches, in linear time.
DECLARATION = rf"(?<![a-zA-Z-])([a-zA-Z-]++)[{WS}]*:[{WS}]*([^;]+)"
#: The name in a match of a call, before which only blanks stand.
CALLED = r"--[\w-]+"
DEFINITION = rf"(--[\w-]+)[{WS}]*:[{WS}]*([^;{{}}]+);"


def without_comments(text: Column) -> Column:
    """struct<blank, masked>, both as long as the text: comments as blanks, and comments whose braces and semicolons do not count.

    The masked text keeps lines and words of comments; marks in them become U+0001.
    """

    def joined(s: Column, change) -> Column:
        return F.array_join(F.zip_with(s["gaps"], F.transform(s["found"], change), lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))), "")

    blanks, hidden = lambda c: F.repeat(F.lit(" "), F.length(c)), lambda c: F.translate(c, "{};", "\x01\x01\x01")
    every = let(
        F.struct(F.split(text, COMMENT, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)).alias("found")),
        lambda s: F.struct(joined(s, blanks).alias("blank"), joined(s, hidden).alias("masked")),
    )
    # the first comment begins at the first mark of one: had it no end, none would have
    comment, begin = F.regexp_extract(text, COMMENT, 0), F.call_function("instr", text, F.lit("/*"))
    before, after = F.substring(text, F.lit(1), begin - 1), F.substring(text, begin + F.length(comment), F.length(text))
    first = F.struct(F.concat(before, blanks(comment), after).alias("blank"), F.concat(before, hidden(comment), after).alias("masked"))
    plain = F.struct(text.alias("blank"), text.alias("masked"))
    return F.when(begin == 0, plain).when(comment == "", plain).when(~F.contains(after, F.lit("/*")), first).otherwise(every)


def blank_comments(text: Column) -> Column:
    """Comments as blanks of the same length, so that offsets stay."""
    return without_comments(text)["blank"]


def _upto(text: Column, at: Column) -> Column:
    return extent(F.substring(text, F.lit(1), at))


#: The last opening brace of a part, with something in front back to the brace before.
OPENED = r"[^{]\{[^{]*\z"


def may_call(text: Column) -> Column:
    """Whether a var() call may stand in what a text's values are once !important is gone."""
    return F.contains(text, F.lit("var(")) | F.contains(text, F.lit("!"))


def rules(files: DataFrame, needed: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, lang, rule_ord, selector, content, rule_line, rule_col, and what declarations are placed by.

    A rule is an innermost block with something in front. The text is cut at
    closing braces: in each part the last opening brace opens the block, and the
    selector goes back to the brace before. Parts are rows before they are taken
    apart; a part's place is that of its piece and the piece's beginning. Where
    needed says so of a rule's content, the rule goes before it is placed; the
    others keep their ordinals.
    """
    # columns of one step that later ones use are kept apart by the optimiser, so each is computed once; filters on them would not be
    d = files.where(F.contains("text", F.lit("}"))).select("path", "lang", without_comments(F.col("text")).alias("t"))
    # what follows the last closing brace is no rule
    closed = lambda c: F.substring_index(F.col(f"t.{c}"), "}", -1)
    d = d.select("path", "lang", *[F.substring(F.col(f"t.{c}"), F.lit(1), F.length(F.col(f"t.{c}")) - F.length(closed(c)) - 1).alias(c) for c in ("blank", "masked")])
    counted = lambda p: p.rlike(OPENED)
    d = d.select("path", "lang", pieces(F.col("blank"), F.col("masked"), "}", counted).alias("ps")).select("path", "lang", F.explode_outer("ps").alias("p"))
    parts = F.filter(F.transform(F.split("p.text", "}", -1), lambda p, k: F.struct(p.alias("text"), k.alias("k"))), lambda p: counted(p["text"]))
    d = d.select("path", "lang", "p", parts.alias("parts")).select("path", "lang", F.col("p.masked").alias("piece"), F.col("p.first").alias("first"), F.col("p.at").alias("from"), F.posexplode_outer("parts").alias("k", "m")).where("k is not null")
    if needed is not None:
        d = d.where(needed(F.substring_index("m.text", "{", -1)))
    d = d.select("path", "lang", (F.col("first") + F.col("k")).alias("rule_ord"), "piece", "from", F.col("m.text").alias("part"), F.length(upto(F.col("piece"), "}", F.col("m.k"))).alias("begin"), F.substring_index("m.text", "{", -1).alias("content"))
    d = d.select("*", F.substring("part", F.lit(1), F.length("part") - F.length("content") - 1).alias("before"))
    d = d.select("*", F.substring_index("before", "{", -1).alias("head"), (F.col("begin") + F.length("before") + 1).alias("inside"))
    d = d.select("*", moved(F.col("from"), _upto(F.col("piece"), F.col("inside") - 1 - F.length("head"))).alias("at"), extent(F.substring("piece", F.col("inside") - F.length("head"), F.length("head") + 1)).alias("over"))
    at = F.col("at")
    return d.select("path", "lang", "rule_ord", js_trim(F.col("head")).alias("selector"), "content", at["line"].alias("rule_line"), at["col"].alias("rule_col"), F.substring("piece", F.col("inside") + 1, F.length("content")).alias("masked"), moved(at, F.col("over")).alias("content_at"))


def declarations(rule_rows: DataFrame, needed: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, rule_ord, decl_ord, property, value, is_definition, and ranges of property and value.

    A declaration lies between two semicolons and reaches to the second; all
    lookups stay inside it. Where needed says no of a declaration's text, from
    its property on, it goes before it is placed; the others keep their ordinals.
    """
    own = ["path", "lang", "rule_ord", "selector", "content_at"]
    d = rule_rows.where(F.contains("content", F.lit(":"))).select(*own, pieces(F.col("content"), F.col("masked"), ";", lambda p: p.rlike(DECLARATION)).alias("ps")).select(*own, F.explode_outer("ps").alias("p"))
    found = F.transform(F.split("p.text", ";", -1), lambda p, k: F.struct(F.regexp_extract(p, DECLARATION, 0).alias("text"), F.length(p).alias("size"), k.alias("k")))
    d = d.select(*own, "p", F.filter(found, lambda m: m["text"] != "").alias("parts"))
    d = d.select("path", "lang", "rule_ord", "selector", F.col("p.masked").alias("piece"), F.col("p.first").alias("first"), moved(F.col("content_at"), F.col("p.at")).alias("from"), F.posexplode_outer("parts").alias("i", "m")).where("i is not null")
    text = F.col("m.text")
    if needed is not None:
        d = d.where(needed(text))
    d = d.select("path", "lang", "rule_ord", (F.col("first") + F.col("i")).alias("decl_ord"), "selector", "piece", "from", text.alias("text"), (F.length(upto(F.col("piece"), ";", F.col("m.k"))) + F.col("m.size") - F.length(text)).alias("begin"))
    # the groups of the pattern without a second match: a value of blanks alone is the last of them
    first = F.ltrim(F.substring("text", F.call_function("instr", F.col("text"), F.lit(":")) + 1, F.length("text")), F.lit(BLANKS))
    d = d.select("*", F.rtrim(F.substring_index("text", ":", 1), F.lit(BLANKS)).alias("property"), first.alias("first"))
    d = d.select("*", F.when(F.col("first") == "", F.right("text", F.lit(1))).otherwise(F.col("first")).alias("raw"))
    # rows of a generator: conditions on property and value stay above it, where both are made already, and below all places
    d = d.select("*", F.array(F.struct("property", js_trim(without_important(F.col("raw"))).alias("value"))).alias("made")).drop("property")
    d = d.select("*", F.explode_outer("made").alias("own")).select("*", "own.property", "own.value").drop("made", "own")
    lead = F.when(F.col("first") == "", 1).otherwise(0)
    d = d.select("*", (F.call_function("instr", F.col("text"), F.col("raw")) - 1 + lead).alias("value_at"), F.substring("piece", F.col("begin") + 1, F.length("text")).alias("masked"), _upto(F.col("piece"), F.col("begin")).alias("to"))
    d = d.select("*", moved(F.col("from"), F.col("to")).alias("at"), _upto(F.col("masked"), F.col("value_at")).alias("to_value"), _upto(F.col("masked"), F.col("value_at") + F.length("value")).alias("to_end"))
    d = d.select("*", moved(F.col("at"), F.col("to_value")).alias("start"), moved(F.col("at"), F.col("to_end")).alias("end"))
    # a value of one line that starts on another line than its property is marked on the property's line if it also stands there
    at = F.col("at")
    line = F.substring_index(F.substring("masked", F.length("property") + 1, F.length("masked")), "\n", 1)
    other = (F.col("to_value.line") > 0) & (F.col("value") != "") & ~F.contains("value", F.lit("\n"))
    d = d.select("*", F.when(other, F.nullif(F.call_function("instr", line, F.col("value")), F.lit(0))).alias("again"))
    back = F.col("again").isNotNull()
    col = at["col"] + F.length("property") + F.col("again") - 1
    return d.select(
        "path", "lang", "rule_ord", "decl_ord", "selector", "property", "value", is_definition(F.col("property")).alias("is_definition"), at["line"].alias("prop_line"), at["col"].alias("prop_col"),
        F.col("start.line").alias("value_line"), F.col("start.col").alias("value_col"), F.when(back, at["line"]).otherwise(F.col("start.line")).alias("start_line"), F.when(back, col).otherwise(F.col("start.col")).alias("start_col"),
        F.when(back, at["line"]).otherwise(F.col("end.line")).alias("end_line"), F.when(back, col + F.length("value")).otherwise(F.col("end.col")).alias("end_col"),
    )


def calls(values: DataFrame, *, others: bool = False) -> DataFrame:
    """The rows with ord, name, fallback and range (call_line, call_col, call_end_line, call_end_col) of each var() call of value, which stands at value_line and value_col.

    others keeps a row without a call, its ord null, before those of each value.
    A lone call is looked up in its value; where there are several, their places
    go with them and the value does not.
    """
    kept = "array<struct<ord:int,match:string,offset:int,line:int,col:int>>"
    found = F.when(F.contains("value", F.lit("var(")), F.regexp_extract_all("value", F.lit(VAR), F.lit(0)))
    d = values.select("*", found.alias("__found"))
    n, none = F.lit(None).cast("int"), F.array().cast(kept)
    alone = F.array(F.struct(F.lit(0), F.get("__found", F.lit(0)), n, n, n)).cast(kept)
    several = F.transform(matches(F.col("value"), VAR), lambda m, k: F.struct(k, m["match"], m["offset"], m["line"], m["col"])).cast(kept)
    every = F.when(F.size("__found") == 1, alone).when(F.size("__found") > 1, several).otherwise(none)
    if others:
        every = F.concat(F.array(F.struct(n, F.lit(None).cast("string"), n, n, n)).cast(kept), every)
    d = d.select(*values.columns, every.alias("__every"), F.when(F.size("__found") == 1, F.col("value")).alias("__lone"))
    rest = [c for c in values.columns if c != "value" or others]
    if others:
        # the value itself stays with its own row only
        d = d.select(*[c for c in values.columns if c != "value"], "__lone", F.explode_outer(F.transform("__every", lambda m: F.struct(m.alias("m"), F.when(m["ord"].isNull(), F.col("value")).alias("value")))).alias("e")).select("*", F.col("e.m").alias("m"), F.col("e.value").alias("value")).drop("e")
    else:
        # an inner explode would get a filter on its size, which makes the array twice
        d = d.select(*rest, "__lone", F.explode_outer("__every").alias("m")).where("m is not null")
    call = F.col("m.match")
    fallback = F.when(F.contains(call, F.lit(",")), F.nullif(js_trim(F.regexp_extract(call, VAR, 2)), F.lit("")))
    before = extent(F.substring("__lone", F.lit(1), F.call_function("instr", F.col("__lone"), call) - 1))
    d = d.select(*rest, F.col("m.ord").alias("ord"), F.regexp_extract(call, CALLED, 0).alias("name"), fallback.alias("fallback"), F.when(F.col("m.line").isNotNull(), F.col("m").dropFields("ord", "match")).otherwise(before).alias("__before"), extent(call).alias("__over"))
    at = place(F.lit(0), F.col("value_line"), F.col("value_col"))
    d = d.select("*", moved(at, F.col("__before")).alias("__start"))
    d = d.select("*", moved(F.col("__start"), F.col("__over")).alias("__end"))
    return d.select(*rest, "ord", "name", "fallback", *[F.col(f"__{a}.{b}").alias(f"call_{c}") for a, b, c in (("start", "line", "line"), ("start", "col", "col"), ("end", "line", "end_line"), ("end", "col", "end_col"))])


def var_uses(decls: DataFrame) -> DataFrame:
    """path, rule_ord, decl_ord, use_ord, name, fallback and the range of each var() call."""
    u = calls(decls.select("path", "lang", "rule_ord", "decl_ord", "property", "value", "value_line", "value_col"))
    return u.select("path", "lang", "rule_ord", "decl_ord", F.col("ord").alias("use_ord"), "property", "name", "fallback", F.col("call_line").alias("start_line"), F.col("call_col").alias("start_col"), F.col("call_end_line").alias("end_line"), F.col("call_end_col").alias("end_col"))


def rule_definitions(decls: DataFrame) -> DataFrame:
    """Definitions that stand as declarations in a rule (the full parse)."""
    return decls.where("is_definition").select("path", "rule_ord", "decl_ord", definition_name(F.col("property")).alias("name"), "value", is_color(F.col("value")).alias("is_color"), F.col("prop_line").alias("line"), F.col("prop_col").alias("col"))


def definitions(files: DataFrame) -> DataFrame:
    """Definitions of the index: anywhere in the raw text, comments included, with their semicolon."""
    found = files.where(F.col("text").isNotNull()).select("path", "pattern_ord", F.explode_outer(matches(F.col("text"), DEFINITION)).alias("m")).where("m is not null")
    found = found.select("path", "pattern_ord", F.regexp_extract("m.match", DEFINITION, 1).alias("name"), clean_value(F.regexp_extract("m.match", DEFINITION, 2)).alias("value"), "m.line", "m.col", "m.offset")
    return found.withColumn("is_color", is_color(F.col("value")))


def document_uses(files: DataFrame) -> DataFrame:
    """var() calls anywhere in the raw text, without regard to rules."""
    found = files.where(F.col("text").isNotNull()).select("path", F.posexplode_outer(matches(F.col("text"), VAR)).alias("use_ord", "m")).where("m is not null")
    call = F.col("m.match")
    fallback = js_trim(F.regexp_extract(call, VAR, 2))
    return found.select("path", "use_ord", F.regexp_extract(call, VAR, 1).alias("name"), F.when(fallback != "", fallback).alias("fallback"), "m.line", "m.col")


def parse_errors(files: DataFrame) -> DataFrame:
    """Documents that cannot be parsed: those without a text."""
    return files.where(F.col("text").isNull()).select("path", F.lit("Error parseando CSS: Error desconocido").alias("message"), F.lit(0).alias("line"), F.lit(0).alias("col"))
