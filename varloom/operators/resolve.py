"""Alias resolution with bounded depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.config import MAX_DEPTH
from varloom.functions.color import is_color, parse_color
from varloom.functions.text import replace_first
from varloom.functions.values import VAR

LINK = "struct<name:string,value:string>"


def resolve(index: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """name, found, value, resolved_value, chain, is_color, stop for every indexed name, or for the given names.

    Follows the first var() of each value for at most ten names. The links are
    collected by equi-joins on the next name, one for each depth; values are
    then put in from the tail. A chain that ends at a missing name, a repeated
    name or the depth bound leaves the last link's raw value: stop says which
    (literal, missing, cycle, depth).
    """
    edges = index.select(F.col("name").alias("__n"), F.col("value").alias("__v"), F.when(F.col("value").rlike(VAR), F.regexp_extract("value", VAR, 1)).alias("__next"))
    walk = index.select("name") if names is None else names.select("name").distinct()
    walk = walk.withColumn("next", F.col("name")).withColumn("links", F.array().cast(f"array<{LINK}>")).withColumn("stop", F.lit(None).cast("string")).withColumn("missing", F.lit(None).cast("string"))
    for _ in range(MAX_DEPTH):
        seen = F.exists("links", lambda x: x["name"] == F.col("next"))
        walk = walk.withColumn("stop", F.when(F.col("stop").isNull() & seen, "cycle").otherwise(F.col("stop"))).withColumn("next", F.when(F.col("stop").isNull(), F.col("next")))
        # a finished row gets a key of its own that no name has, so that these rows do not gather
        walk = walk.withColumn("__key", F.coalesce("next", F.concat(F.lit("\0"), "name"))).join(edges, F.col("__key") == F.col("__n"), "left")
        hit = F.col("__n").isNotNull()
        walk = walk.withColumn("missing", F.when(F.col("stop").isNull() & ~hit, F.col("next")).otherwise(F.col("missing")))
        walk = walk.withColumn("links", F.when(hit, F.concat("links", F.array(F.struct(F.col("__n").alias("name"), F.col("__v").alias("value"))))).otherwise(F.col("links")))
        stop = F.when(F.col("stop").isNotNull(), F.col("stop")).when(~hit, "missing").when(F.col("__next").isNull(), "literal")
        walk = walk.select("name", F.when(stop.isNull(), F.col("__next")).alias("next"), "links", stop.alias("stop"), "missing")
    seen = F.exists("links", lambda x: x["name"] == F.col("next"))
    walk = walk.withColumn("stop", F.coalesce("stop", F.when(seen, "cycle").otherwise("depth")))
    # from the tail: what a link refers to has been resolved, so its call takes the value; the last link keeps its own
    tail = F.reverse("links")
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
    resolved = F.aggregate(tail, start, lambda acc, x: F.struct(x["name"].alias("name"), F.when(acc["name"].isNull(), x["value"]).otherwise(replace_first(x["value"], F.concat(F.lit("var("), acc["name"], F.lit(")")), acc["value"])).alias("value")), lambda acc: acc["value"])
    found = F.size("links") > 0
    chain = F.transform("links", lambda x: x["name"])
    out = walk.withColumn("resolved_value", resolved).withColumn("found", found).withColumn("value", F.get("links", F.lit(0))["value"]).withColumn("chain", F.when(F.col("missing").isNotNull(), F.concat(chain, F.array("missing"))).otherwise(chain))
    # a chain of one unresolved link keeps the raw value's colour; any other is judged by what it resolved to
    return out.select("name", "found", "value", "resolved_value", "chain", F.coalesce(is_color(F.col("resolved_value")), F.lit(False)).alias("is_color"), "stop")


def resolved_values(index: DataFrame, resolved: DataFrame) -> DataFrame:
    """The index with resolved_value: the resolved text, or the raw one where that is empty."""
    r = resolved.select("name", F.coalesce(F.nullif("resolved_value", F.lit("")), F.col("value")).alias("resolved_value"))
    return index.join(r, "name")


def color_info(resolved: DataFrame) -> DataFrame:
    """name and the colour of its resolved value, where it is one."""
    return resolved.select("name", parse_color(F.col("resolved_value")).alias("color")).where(F.col("color").isNotNull())


def descriptions(index: DataFrame, resolved: DataFrame) -> DataFrame:
    """name and a Markdown description: value, resolved value and chain where they differ, file and line."""
    r = resolved.join(index.select("name", "path", "line"), "name", "left")
    lines = F.filter(
        F.array(
            F.concat(F.lit("**"), "name", F.lit("**")), F.lit(""), F.concat(F.lit("\U0001f4c4 **Valor:** `"), "value", F.lit("`")),
            F.when(F.col("resolved_value") != F.col("value"), F.concat(F.lit("\U0001f517 **Resuelto:** `"), "resolved_value", F.lit("`"))),
            F.when(F.size("chain") > 1, ""), F.when(F.size("chain") > 1, F.concat(F.lit("\U0001f504 **Cadena:** "), F.array_join("chain", " → "))),
            F.lit(""), F.concat(F.lit("\U0001f4cd **Archivo:** "), "path"), F.concat(F.lit("\U0001f4cd **Línea:** "), F.col("line") + 1),
        ),
        lambda x: x.isNotNull(),
    )
    missing = F.concat(F.lit("❌ Variable `"), "name", F.lit("` no encontrada"))
    return r.select("name", F.when(F.col("found"), F.array_join(lines, "\n")).otherwise(missing).alias("description"))
