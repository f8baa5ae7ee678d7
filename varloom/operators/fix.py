"""Applying quick fixes to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.text import offset_of, splice


def chosen_actions(actions: DataFrame) -> DataFrame:
    """One action for each marked range of a document: the preferred one, else the first offered."""
    place = ["path", "start_line", "start_col", "end_line", "end_col"]
    edit = F.struct("edit_line", "edit_start", "edit_end_line", "edit_end", "new_text")
    order = F.struct((~F.col("is_preferred")).alias("p"), "phase", "o0", "o1", "o2", "rank")
    return actions.groupBy(*place).agg(F.min_by(edit, order).alias("e")).select("path", "e.*").where("new_text is not null")


def apply_actions(files: DataFrame, actions: DataFrame) -> DataFrame:
    """path, text, n_fixes of each style sheet with applicable actions.

    Edits go from the end of the text to its start; one that overlaps an edit
    already made is left out. A document gathers its own edits only.
    """
    style = files.where(F.col("path").rlike(r"(?i)\.(css|scss|less)\z"))
    edits = chosen_actions(actions).groupBy("path").agg(F.collect_list(F.struct("edit_line", "edit_start", "edit_end_line", "edit_end", "new_text")).alias("edits"))
    joined = style.select("path", "text").join(edits, "path")
    t = F.col("text")
    placed = F.transform("edits", lambda e: F.struct(offset_of(t, e["edit_line"], e["edit_start"]).alias("start"), offset_of(t, e["edit_end_line"], e["edit_end"]).alias("end"), e["new_text"].alias("new_text")))
    placed = F.sort_array(placed, asc=False)
    start = F.struct(t.alias("text"), F.length(t).alias("from"), F.lit(0).alias("n"))

    def step(s: Column, e: Column) -> Column:
        fits = e["end"] <= s["from"]
        return F.when(fits, F.struct(splice(s["text"], e["start"], e["end"], e["new_text"]).alias("text"), e["start"].alias("from"), (s["n"] + 1).alias("n"))).otherwise(s)

    return joined.withColumn("out", F.aggregate(placed, start, step)).select("path", F.col("out.text").alias("text"), F.col("out.n").alias("n_fixes"))


def fixed_files(files: DataFrame, applied: DataFrame) -> DataFrame:
    """All documents, with the texts of apply_actions where there are any."""
    done = applied.select("path", F.col("text").alias("__text"))
    return files.join(done, "path", "left").withColumn("text", F.coalesce("__text", "text")).drop("__text")
