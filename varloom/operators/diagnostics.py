"""Findings: undefined uses, hardcoded values, inline styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.config import ERROR, HARDCODED, INLINE, REACT_LANGUAGES, UNDEFINED, AnalyzerConfig
from varloom.functions.text import WS, extent, js_trim, let, matches, moved, place, starts
from varloom.functions.values import is_allowed, is_hardcoded, property_checked
from varloom.operators.parse import calls, declarations, rules
from varloom.sources.files import is_supported

RANGE = ["start_line", "start_col", "end_line", "end_col"]
STYLE_OBJECT = rf"style[{WS}]*=[{WS}]*\{{[{WS}]*\{{"
#: An expression in braces that does not begin with a brace; no look-ahead is needed.
STYLE_EXPRESSION = rf"style[{WS}]*=[{WS}]*\{{([{WS}]*[^}}{{{WS}][^}}]*|[{WS}]+)\}}"


def undefined_uses(uses: DataFrame, index: DataFrame) -> DataFrame:
    """Uses of names that the index lacks. Only names meet, so the index side is narrow whatever its values."""
    return uses.join(index.select("name"), "name", "left_anti")


def defined_uses(uses: DataFrame, index: DataFrame) -> DataFrame:
    return uses.join(index.select("name"), "name", "left_semi")


def hardcoded_values(decls: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """Checked, not allowed, hardcoded values of whole declarations."""
    return decls.where(~F.col("is_definition") & property_checked(F.col("property"), config) & ~is_allowed(F.col("value"), config) & is_hardcoded(F.col("value")))


def hardcoded_fallbacks(uses: DataFrame) -> DataFrame:
    """Hardcoded fallbacks of any use; property settings do not matter."""
    return uses.where(F.col("fallback").isNotNull() & is_hardcoded(F.col("fallback")))


def _components(files: DataFrame, config: AnalyzerConfig, pattern: str) -> DataFrame:
    return files.where(F.col("lang").isin(*REACT_LANGUAGES) & F.lit(config.inline_enabled) & F.col("text").rlike(pattern))


def object_spans(text: Column) -> Column:
    """array<struct<start, end>> of the style={{...}} of a component, as positions.

    The text is cut at its braces, each with the level that it opens or closes.
    Sorted by level and order, the brace after an opening one closes it, so the
    text is read once and its braces sorted once. An object ends where its outer
    brace closes, or with the text.
    """
    braces = F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0))
    # what stands before each brace, with the brace itself; the rest of the text last
    cut = F.zip_with(F.split(text, "[{}]", -1), braces, lambda gap, b: F.struct(gap.alias("gap"), F.coalesce(b, F.lit("")).alias("brace")))

    def spans(parts: Column) -> Column:
        def marked(begin: Column, levels: Column) -> Column:
            def brace(p: Column, k: Column) -> Column:
                level = F.get(levels, k) + F.when(p["brace"] == "{", 1).otherwise(0)
                following = F.get(parts, k + 1)
                opens = (p["brace"] == "{") & p["gap"].rlike(rf"style[{WS}]*=[{WS}]*\z") & (following["brace"] == "{") & following["gap"].rlike(rf"^[{WS}]*\z")
                head = F.regexp_extract(p["gap"], rf"style[{WS}]*=[{WS}]*\z", 0)
                at = F.get(begin, k)
                start = moved(at, extent(F.substring(p["gap"], F.lit(1), F.length(p["gap"]) - F.length(head))))
                return F.struct(level.alias("level"), k.alias("k"), F.coalesce(opens, F.lit(False)).alias("opens"), start.alias("start"), moved(at, extent(F.concat(p["gap"], p["brace"]))).alias("end"))

            sorted_ = F.array_sort(F.filter(F.transform(parts, brace), lambda b: b["k"] < F.size(parts) - 1))
            last = moved(F.get(begin, F.size(parts) - 1), extent(F.get(parts, F.size(parts) - 1)["gap"]))

            def span(s: Column) -> Column:
                def one(b: Column, i: Column) -> Column:
                    after = F.get(s, i + 1)
                    end = F.when(after["level"] == b["level"], after["end"]).otherwise(last)
                    return F.when(b["opens"], F.struct(b["start"].alias("start"), end.alias("end")))

                return F.array_sort(F.filter(F.transform(s, one), lambda x: x.isNotNull()))

            return let(sorted_, span)

        level = lambda p: place(F.when(p["brace"] == "{", 1).when(p["brace"] == "}", -1).otherwise(0), F.lit(0), F.lit(0))
        begin = starts(F.transform(parts, lambda p: extent(F.concat(p["gap"], p["brace"]))))
        levels = F.transform(starts(F.transform(parts, level)), lambda p: p["offset"])
        return let(begin, lambda b: let(levels, lambda n: marked(b, n)))

    return let(cut, spans)


def inline_objects(files: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """style={{...}} in components, up to the brace that closes the first; to the text's end where none does."""
    found = _components(files, config, STYLE_OBJECT).select("path", F.posexplode_outer(object_spans(F.col("text"))).alias("ord", "m")).where("m is not null")
    message = F.lit("CSS inline detectado — usa clases CSS con variables en vez de style={{}}")
    return found.select("path", F.lit(0).alias("phase"), "ord", message.alias("message"), *_range(F.col("m.start"), F.col("m.end")))


def inline_expressions(files: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """style={expression} in components, up to the first closing brace."""
    found = _components(files, config, STYLE_EXPRESSION).select("path", F.posexplode_outer(matches(F.col("text"), STYLE_EXPRESSION)).alias("ord", "m")).where("m is not null")
    content = js_trim(F.regexp_extract("m.match", STYLE_EXPRESSION, 1))
    message = F.concat(F.lit("CSS inline detectado (style={"), content, F.lit("}) — usa clases CSS con variables"))
    return found.select("path", F.lit(1).alias("phase"), "ord", message.alias("message"), *_range(F.col("m"), moved(F.col("m"), extent(F.col("m.match")))))


def _range(start: Column, end: Column) -> list[Column]:
    return [start["line"].alias("start_line"), start["col"].alias("start_col"), end["line"].alias("end_line"), end["col"].alias("end_col")]


#: Shares over which the uses of a name are dealt when they meet the index, so that a name which every sheet uses is no single task's.
SHARES = 8


def _style_findings(decls: DataFrame, index: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """Undefined uses, hardcoded fallbacks and hardcoded values of declarations, parsed once and joined once with the index's names."""
    kept = "struct<phase:int,ord:int,name:string,value:string,start_line:int,start_col:int,end_line:int,end_col:int>"

    def item(phase: int, ord_: Column, name: Column, value: Column, place_: list[str]) -> Column:
        return F.struct(F.lit(phase), ord_, name, value, *place_).cast(kept)

    none = F.lit(None).cast("string")
    checked = ~F.col("is_definition") & property_checked(F.col("property"), config) & ~is_allowed(F.col("value"), config) & is_hardcoded(F.col("value"))
    d = decls.select("path", "rule_ord", "decl_ord", "property", "is_definition", "value", "value_line", "value_col", *RANGE)
    d = calls(d.select("*", checked.alias("checked")).where(F.col("checked") | F.contains("value", F.lit("var("))), others=True)
    spot = ["call_line", "call_col", "call_end_line", "call_end_col"]
    own = F.when(F.col("checked"), F.array(item(2, F.lit(0), none, F.col("value"), RANGE)))
    use = item(0, F.col("ord"), F.col("name"), none, spot)
    called = F.when(F.col("fallback").isNotNull() & is_hardcoded(F.col("fallback")), F.array(use, item(1, F.col("ord"), none, F.col("fallback"), spot))).otherwise(F.array(use))
    every = F.when(F.col("ord").isNotNull(), called).otherwise(own)
    rows = d.select("path", "rule_ord", "decl_ord", "property", every.alias("every")).select("path", "rule_ord", "decl_ord", "property", F.explode_outer("every").alias("f")).where("f is not null").select("path", "rule_ord", "decl_ord", "property", "f.*")
    # findings without a name have keys of their own, which no share of the index has
    spread = F.pmod(F.xxhash64("path", "rule_ord", "decl_ord", "ord"), F.lit(1 << 30))
    rows = rows.withColumn("__name", F.coalesce("name", F.lit(""))).withColumn("__share", F.when(F.col("phase") == 0, F.pmod(F.xxhash64("path"), F.lit(SHARES))).otherwise(-1 - spread))
    known = index.select(F.col("name").alias("__name"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("__share"))
    rows = rows.join(known, ["__name", "__share"], "left_anti")
    text = F.when(F.col("phase") == 0, F.concat(F.lit("Variable '"), "name", F.lit("' no está definida"))).otherwise(F.concat(F.lit("Valor hardcodeado '"), "value", F.lit("' en '"), "property", F.lit("' - considera usar una variable CSS")))
    missing = F.col("phase") == 0
    return rows.select(
        "path", "phase", F.col("rule_ord").alias("o0"), F.col("decl_ord").alias("o1"), F.col("ord").alias("o2"), F.when(missing, UNDEFINED).otherwise(HARDCODED).alias("kind"), F.when(missing, ERROR).otherwise(config.hardcoded_severity).alias("severity"),
        text.alias("message"), F.when(~missing, F.col("property")).alias("property"), "value", F.col("name").alias("var_name"), *RANGE,
    )


def diagnostics(files: DataFrame, index: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """path, phase, ord parts, kind, severity, message, property, value, var_name and range of every finding.

    Order in a document: undefined uses, hardcoded fallbacks, hardcoded values;
    components have inline findings only, objects before expressions. A style
    sheet is parsed once: its declarations make all candidates, which meet the
    names of the index in one join.
    """
    if not config.enabled:
        files = files.limit(0)
    known = files.where(is_supported(config))
    styles = known.where(~F.col("lang").isin(*REACT_LANGUAGES))
    found = _style_findings(declarations(rules(styles)), index, config)
    none = F.lit(None).cast("string")
    inline = inline_objects(known, config).unionByName(inline_expressions(known, config))
    inline = inline.select("path", "phase", F.col("ord").alias("o0"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit(INLINE).alias("kind"), F.lit(config.inline_severity).alias("severity"), "message", none.alias("property"), none.alias("value"), none.alias("var_name"), *RANGE)
    return found.unionByName(inline)
