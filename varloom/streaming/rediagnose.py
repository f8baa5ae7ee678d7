"""Findings after a change: only documents that changed, or that use a name which came or went, are diagnosed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.config import REACT_LANGUAGES, AnalyzerConfig
from varloom.operators.diagnostics import diagnostics
from varloom.functions.values import VAR
from varloom.sources.buckets import BucketTable, bucket_of
from varloom.sources.shared import written

USES, FINDINGS = "name string, path string", "path string, phase int, o0 int, o1 int, o2 int, kind string, severity int, message string, property string, value string, var_name string, start_line int, start_col int, end_line int, end_col int"


def name_uses(files: DataFrame) -> DataFrame:
    """name and path: the inverted index from names to the style sheets that call them, once each."""
    # only the names of calls, each once a document: no places, and nothing to shuffle where paths are distinct
    styles = files.where(~F.col("lang").isin(*REACT_LANGUAGES) & F.contains("text", F.lit("var(")))
    return styles.select(F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(VAR), F.lit(1)))).alias("name"), "path").where("name is not null")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that one of two indexes has and the other lacks; a name that only changed its value makes no finding come or go."""
    sides = before.select("name", F.lit(1).alias("side")).unionByName(after.select("name", F.lit(2).alias("side")))
    return sides.groupBy("name").agg(F.min("side").alias("first"), F.max("side").alias("last")).where("first = last").select("name")


def affected(changed: DataFrame, names: DataFrame, uses: DataFrame) -> DataFrame:
    """Paths to diagnose again: the changed ones, and those that call a changed name."""
    return changed.select("path").unionByName(uses.join(names, "name", "left_semi").select("path")).distinct()


def rediagnose(stored: DataFrame, uses: DataFrame, files: DataFrame, changed: DataFrame, before: DataFrame, after: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """All findings after a change, from those stored before it.

    stored: findings before; uses: name_uses before; files: all documents after;
    changed: paths that were written or deleted; before and after: the indexes.
    Documents that are not affected are neither parsed nor joined with the index.
    The affected paths are written once, since every kind of finding reads them.
    """
    touched = written(affected(changed, changed_names(before, after), uses), "affected")
    again = diagnostics(files.join(touched, "path", "left_semi"), after, config)
    return stored.join(touched, "path", "left_anti").unionByName(again)


class FindingsStore:
    """Findings and the inverted index, by buckets of the path, kept in step with changes of documents."""

    def __init__(self, spark: SparkSession, path: str, config: AnalyzerConfig | None = None):
        self.spark, self.config = spark, config or AnalyzerConfig()
        self.findings, self.uses = BucketTable(spark, f"{path}/findings", FINDINGS), BucketTable(spark, f"{path}/uses", USES)

    def update(self, files: DataFrame, changed: DataFrame, before: DataFrame, after: DataFrame) -> None:
        """Take a change over.

        files: all documents after; changed: paths written or deleted. Buckets
        without an affected path stay as they are. Uses are written last: an
        update that breaks off between the two is done again by the same call.
        """
        changed = changed.select("path").where("path is not null").distinct().persist()
        touched = affected(changed, changed_names(before, after), self.uses.read()).persist()
        try:
            hit = [r[0] for r in touched.select(bucket_of(F.col("path")).alias("b")).distinct().collect()]  # at most as many as buckets
            if hit:
                again = diagnostics(files.join(touched, "path", "left_semi"), after, self.config)
                self.findings.replace(self.findings.read(hit).join(touched, "path", "left_anti").unionByName(again.select(*[c.split()[0] for c in FINDINGS.split(", ")])), hit)
            own = [r[0] for r in changed.select(bucket_of(F.col("path")).alias("b")).distinct().collect()]
            if own:
                self.uses.replace(self.uses.read(own).join(changed, "path", "left_anti").unionByName(name_uses(files.join(changed, "path", "left_semi"))), own)
        finally:
            changed.unpersist()
            touched.unpersist()
