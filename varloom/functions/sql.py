"""Scalar functions as SQL temporary functions, inlined by the optimiser."""

from __future__ import annotations

from pyspark.sql import SparkSession

from varloom.functions.color import FUNCTIONAL, NAMED
from varloom.functions.text import WS
from varloom.functions.values import NAME, NUMBER, UNITS, VAR


def _text(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return 'r"' + pattern.replace('"', '\\"') + '"'


def functions(prefix: str = "css_") -> dict[str, str]:
    """Name -> definition (parameters, type and body)."""
    p = prefix
    trim = f"regexp_replace(v, {_text(f'^[{WS}]+|[{WS}]+\\z')}, '')"
    names = ", ".join(f"'{n}'" for n in NAMED)
    forms = " OR ".join(f"rlike({p}trim(lower(v)), {_text(f)})" for f in FUNCTIONAL.values())
    return {
        f"{p}trim": f"(v STRING) RETURNS STRING RETURN {trim}",
        f"{p}is_color": f"(v STRING) RETURNS BOOLEAN RETURN {p}trim(lower(v)) IN ({names}) OR rlike({p}trim(lower(v)), {_text(r'^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})\z')}) OR {forms}",
        f"{p}is_hardcoded": f"(v STRING) RETURNS BOOLEAN RETURN NOT contains(v, 'var(') AND ({p}is_color(v) OR rlike({p}trim(v), {_text(rf'(?i)^(rgb|hsl)a?[{WS}]*\(')}) OR rlike({p}trim(v), {_text(rf'(?i){NUMBER}({UNITS})\z')}))",
        f"{p}definition_name": f"(v STRING) RETURNS STRING RETURN nullif(regexp_extract(v, {_text(NAME)}, 1), '')",
        f"{p}first_var": f"(v STRING) RETURNS STRING RETURN nullif(regexp_extract(v, {_text(VAR)}, 1), '')",
        f"{p}similarity": "(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN length(a) + length(b) = 0 THEN 1D ELSE (greatest(length(a), length(b)) - levenshtein(a, b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) END",
        f"{p}line_of": "(t STRING, o INT) RETURNS INT RETURN length(substr(t, 1, o)) - length(replace(substr(t, 1, o), '\\n', ''))",
        f"{p}column_of": "(t STRING, o INT) RETURNS INT RETURN length(substring_index(substr(t, 1, o), '\\n', -1))",
        f"{p}rgb_distance": "(r1 INT, g1 INT, b1 INT, r2 INT, g2 INT, b2 INT) RETURNS DOUBLE RETURN sqrt(power(r1 - r2, 2) + power(g1 - g2, 2) + power(b1 - b2, 2))",
    }


def register_functions(spark: SparkSession, prefix: str = "css_") -> None:
    for name, body in functions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
