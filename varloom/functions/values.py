"""Declaration values: cleaning, var() calls, hardcoded values, property classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.config import AnalyzerConfig
from varloom.functions.color import is_color
from varloom.functions.text import WS, extent, js_trim, let, matches, moved, place

_S = f"[{WS}]"
VAR = rf"var\({_S}*(--[\w-]+){_S}*(?:,{_S}*([^)]+))?{_S}*\)"
NAME = rf"^{_S}*(--[\w-]+){_S}*\z"
NUMBER = r"^-?\d+(\.\d+)?"
UNITS = "px|em|rem|%|vh|vw|vmin|vmax|ch|ex|cm|mm|in|pt|pc|deg|rad|turn|s|ms"

# Property classes.
COLOR_PROPERTIES = (
    "color", "background-color", "background", "border-color", "border-top-color", "border-right-color", "border-bottom-color", "border-left-color",
    "outline-color", "text-decoration-color", "fill", "stroke", "caret-color", "column-rule-color", "accent-color",
)
FONT_PROPERTIES = ("font-size", "font-weight", "line-height", "letter-spacing", "word-spacing", "font-family")
SPACING_PROPERTIES = (
    "margin", "margin-top", "margin-right", "margin-bottom", "margin-left", "padding", "padding-top", "padding-right", "padding-bottom", "padding-left", "gap", "row-gap", "column-gap",
)


def without_important(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit("!")), F.regexp_replace(raw, "(?i)!important", "")).otherwise(raw)


def clean_value(raw: Column) -> Column:
    """Without !important, one last semicolon and outer white space."""
    return js_trim(F.regexp_replace(without_important(raw), r";\z", ""))


def fallback_of(call: Column) -> Column:
    """Fallback of one var() call, trimmed; null where there is none."""
    text = js_trim(F.regexp_extract(call, VAR, 2))
    return F.when(text != "", text)


def var_calls(value: Column) -> Column:
    """array<struct<call, name, fallback, start, end>> of the var() calls of a value; start and end are positions."""

    def of(m: Column) -> Column:
        start = place(m["offset"], m["line"], m["col"])
        return F.struct(m["match"].alias("call"), F.regexp_extract(m["match"], VAR, 1).alias("name"), fallback_of(m["match"]).alias("fallback"), start.alias("start"), moved(start, extent(m["match"])).alias("end"))

    return F.transform(matches(value, VAR), of)


def is_definition(prop: Column) -> Column:
    return prop.rlike(NAME)


def definition_name(prop: Column) -> Column:
    """Name that a property defines, or null."""
    return F.when(is_definition(prop), F.regexp_extract(prop, NAME, 1))


HEX_VALUE = r"(?i)^#(?:[0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})\z"
CALL_VALUE = rf"(?i)^(rgb|hsl)a?{_S}*\("


def is_hardcoded(value: Column) -> Column:
    """A colour, an rgb or hsl call, or a number with a unit, as the whole value and without var()."""
    return let(js_trim(value), lambda v: ~F.contains(v, F.lit("var(")) & (v.rlike(HEX_VALUE) | v.rlike(CALL_VALUE) | v.rlike(rf"(?i){NUMBER}({UNITS})\z") | is_color(v)))


def value_kind(value: Column) -> Column:
    """color, numero or otro."""
    return let(js_trim(value), lambda v: F.when(v.rlike(HEX_VALUE) | v.rlike(CALL_VALUE) | is_color(v), "color").when(v.rlike(rf"(?i){NUMBER}({UNITS})?\z"), "numero").otherwise("otro"))


def property_checked(prop: Column, config: AnalyzerConfig) -> Column:
    """Whether a property's values are checked: by its own setting, else by that of the part before its first hyphen."""
    if not config.hardcoded_enabled or not config.properties:
        return F.lit(False)
    setting = F.create_map(*[x for k, v in config.properties.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(setting, prop), F.element_at(setting, F.substring_index(prop, "-", 1)), F.lit(False))


def is_allowed(value: Column, config: AnalyzerConfig) -> Column:
    return F.lower(js_trim(value)).isin(*[a.lower() for a in config.allowed])


def property_class(prop: Column) -> Column:
    """color, font or spacing; null for any other property."""
    p = F.lower(prop)
    return F.when(p.isin(*COLOR_PROPERTIES), "color").when(p.isin(*FONT_PROPERTIES), "font").when(p.isin(*SPACING_PROPERTIES), "spacing")


def normalize_value(value: Column) -> Column:
    """Trimmed, lower-case, with single blanks, a blank after commas and none around brackets."""
    v = F.regexp_replace(F.lower(js_trim(value)), f"{_S}+", " ")
    v = F.regexp_replace(v, f"{_S}*,{_S}*", ", ")
    return F.regexp_replace(F.regexp_replace(v, rf"{_S}*\({_S}*", "("), rf"{_S}*\){_S}*", ")")


def split_compound(value: Column) -> Column:
    """Parts of a value between blanks that stand outside brackets."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        cut = (c == " ") & (s["depth"] == 0)
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        done = F.when(cut & (js_trim(s["part"]) != ""), F.concat(s["out"], F.array(js_trim(s["part"])))).otherwise(s["out"])
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["part"], c)).alias("part"), done.alias("out"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: F.when(js_trim(s["part"]) != "", F.concat(s["out"], F.array(js_trim(s["part"])))).otherwise(s["out"]))
