"""Reports over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.config import ERROR, EXAMPLES, HINT, INFORMATION, WARNING
from varloom.functions.globs import base_name

TITLE = "=== Reporte de escaneo global ==="


def _first_examples() -> Column:
    """The first messages of a document in the order of its findings.

    A bounded minimum for each place would need a custom aggregate; findings of
    one document are as many as its text allows.
    """
    item = F.struct("phase", "o0", "o1", "o2", F.concat(F.lit("L"), F.col("start_line") + 1, F.lit(": "), "message").alias("text"))
    return F.transform(F.slice(F.array_sort(F.collect_list(item)), 1, EXAMPLES), lambda x: x["text"])


def file_report(diagnostics: DataFrame) -> DataFrame:
    """path, total, errors, warnings, info, hints, examples of each document with findings."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return diagnostics.groupBy("path").agg(F.count("*").alias("total"), of(ERROR).alias("errors"), of(WARNING).alias("warnings"), of(INFORMATION).alias("info"), of(HINT).alias("hints"), _first_examples().alias("examples"))


def project_totals(diagnostics: DataFrame, visited: DataFrame) -> DataFrame:
    """total_diagnostics, files_analyzed, files_with_problems; unsupported and unreadable documents count as analysed."""
    counts = diagnostics.groupBy("path").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_diagnostics"), F.count("*").alias("files_with_problems"))
    return counts.join(visited.agg(F.countDistinct("path").alias("files_analyzed"))).select("total_diagnostics", "files_analyzed", "files_with_problems")


def report_totals(report: DataFrame, visited: DataFrame) -> DataFrame:
    """project_totals from the report of each document instead of the findings."""
    counts = report.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_diagnostics"), F.count("*").alias("files_with_problems"))
    return counts.join(visited.agg(F.countDistinct("path").alias("files_analyzed"))).select("total_diagnostics", "files_analyzed", "files_with_problems")


def project_result(report: DataFrame, totals: DataFrame) -> DataFrame:
    """The whole result of a project scan: its totals beside the report of each document with findings; a row without a path where there is none."""
    return totals.join(report, F.lit(True), "left")


def ordered_report(report: DataFrame) -> DataFrame:
    """By falling errors, then falling totals, then path."""
    return report.orderBy(F.desc("errors"), F.desc("total"), "path")


def report_lines(report: DataFrame, totals: DataFrame) -> DataFrame:
    """path and text: a block for each document and, with a null path, the header. Sort by errors and total to print."""
    head = totals.select(
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("errors"), F.lit(None).cast("long").alias("total"),
        F.concat(F.lit(TITLE + "\nTotal diagnósticos: "), "total_diagnostics", F.lit("\nArchivos analizados: "), "files_analyzed", F.lit("\nArchivos con problemas: "), "files_with_problems", F.lit("\n")).alias("text"),
    )
    counts = F.concat(F.lit("  Total: "), "total", F.lit(" | Errores: "), "errors", F.lit(" | Warnings: "), "warnings", F.lit(" | Info: "), "info", F.lit(" | Hint: "), "hints", F.lit("\n"))
    each = F.array_join(F.transform("examples", lambda x: F.concat(F.lit("    - "), x, F.lit("\n"))), "")
    return head.unionByName(report.select("path", "errors", "total", F.concat(F.lit("• "), "path", F.lit("\n"), counts, each).alias("text")))


def quick_list(report: DataFrame) -> DataFrame:
    """label, description and detail of each document with findings."""
    icon = F.when(F.col("errors") > 0, "$(error) ").otherwise("$(warning) ")
    name = F.when(base_name(F.col("path")) != "", base_name(F.col("path"))).otherwise(F.col("path"))
    return report.select(F.concat(icon, name).alias("label"), F.concat("total", F.lit(" problema(s) · E:"), "errors", F.lit(" W:"), "warnings").alias("description"), F.col("path").alias("detail"))
