"""Removal of boilerplate lines that many sites share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r"
#: Beginning of the names of working columns.
DROPS = "__varloom_drops"


def _hash(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    each = docs.select("doc_id", "site", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))))).alias("line"))
    return each.where(F.length("line") >= min_chars).select("doc_id", "site", *_hash(F.col("line")))


def spread_of_lines(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """h1, h2, first_doc of each line seen on at least min_sites distinct sites.

    A HyperLogLog sketch of the sites of each line hash is made in the map tasks
    and merged by the aggregation. Lines whose estimate is within five standard
    errors of the threshold get an exact distinct count.
    """
    band = 5 * 1.04 / math.sqrt(2**lg_k)
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("est"), F.min("doc_id").alias("first_doc")).where(F.col("est") >= low)
    near = spread.where(F.col("est") <= high)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    sure = spread.where(F.col("est") > high).select("h1", "h2", "first_doc")
    return sure.unionByName(near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first_doc"))


def line_dedup(docs: DataFrame, min_sites: int = 10, min_chars: int = 20, lg_k: int = 12, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The input's rows and columns with cross-site boilerplate lines removed, plus n_removed.

    A line, trimmed of blanks, tabs and carriage returns, of at least min_chars
    characters is boilerplate when it occurs on min_sites or more distinct
    values of the site column (null is one site of its own). It stays in the
    document with the smallest id that has it and goes from all others that have
    an id; documents without one keep it. Line order and all other lines are
    untouched. A null text stays null and loses nothing. Rows that share an id
    are judged alike. Extra columns pass through; a column named n_removed is
    replaced.
    """
    from varloom.llm.common import materialise

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("-")).alias("site"), F.col(text_col).alias("text"))
    lines = _lines(own, min_chars)
    wide = materialise(spread_of_lines(lines, min_sites, lg_k), "spread")
    drops = lines.join(wide, ["h1", "h2"]).where(F.col("doc_id") != F.col("first_doc")).groupBy("doc_id").agg(F.collect_set("h1").alias(DROPS)).withColumnRenamed("doc_id", DROPS + "_id")
    gone = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: (F.length(F.btrim(x, F.lit(BLANKS))) >= min_chars) & F.array_contains(DROPS, F.xxhash64(F.btrim(x, F.lit(BLANKS)))))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: (F.length(F.btrim(x, F.lit(BLANKS))) < min_chars) | ~F.array_contains(DROPS, F.xxhash64(F.btrim(x, F.lit(BLANKS)))))
    out = docs.drop("n_removed").join(drops, F.col(id_col) == F.col(DROPS + "_id"), "left")
    has = F.col(DROPS).isNotNull() & F.col(text_col).isNotNull()
    out = out.withColumn("n_removed", F.when(has, F.size(gone)).otherwise(F.lit(0)))
    out = out.withColumn(text_col, F.when(has, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    return out.select(*[c for c in docs.columns if c != "n_removed"], "n_removed")
