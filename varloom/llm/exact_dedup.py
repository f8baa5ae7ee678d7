"""Exact deduplication by 128-bit content hash with a byte comparison inside each hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Texts of ASCII alone take the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the normalised text and, inside a hash, by
    the text itself, so two texts that collide stay apart. Grouping combines
    copies before the shuffle: a group of any size sends one row for each map
    task. The row with the largest id stays. A null id never stays over another
    id; when all ids of a group are null all its rows are kept, and rows that
    repeat the largest id are all kept, as nothing tells them apart. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", F.md5("norm"))
    groups = (
        rows.groupBy("h", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    narrow = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return narrow.join(groups, ["h", "text_sha256"]).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
