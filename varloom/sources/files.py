"""Documents to analyse: file trees, tables, scan filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.config import REACT_LANGUAGES, STYLE_LANGUAGES, AnalyzerConfig
from varloom.functions.globs import language_of, matches_any

COLUMNS = ["path", "lang", "text", "pattern_ord"]
SCAN_GLOBS = ("**/*.css", "**/*.scss", "**/*.less")
PROJECT_GLOBS = (*SCAN_GLOBS, "**/*.tsx", "**/*.jsx")


def files_from_table(df: DataFrame) -> DataFrame:
    """files from any table of path and text; lang comes from the extension where it is missing, pattern_ord is 0."""
    df = df if "lang" in df.columns else df.withColumn("lang", language_of(F.col("path")))
    df = df if "pattern_ord" in df.columns else df.withColumn("pattern_ord", F.lit(0))
    return df.select("path", "lang", "text", F.col("pattern_ord").cast("int").alias("pattern_ord"))


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes; null where they are none, so that the document counts as one that cannot be parsed."""
    return F.try_validate_utf8(content.cast("string"))


def read_files(spark: SparkSession, root: str, extensions: str = "{css,scss,sass,less,vue,html,tsx,jsx}") -> DataFrame:
    """files below a root, one row each; the text is null where a file is not UTF-8. Spark lists by extension before it reads, and leaves out files of no bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extensions}").load(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return files_from_table(raw.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), decoded(F.col("content")).alias("text")))


def glob_scan(files: DataFrame, globs: tuple[str, ...] | list[str], exclude: tuple[str, ...] | list[str]) -> DataFrame:
    """Files that a glob lists and no exclusion does, once each, with the ordinal of their first glob."""
    exclude = exclude or ("**/node_modules/**",)
    order = F.coalesce(*[F.when(matches_any(F.col("path"), [g]), F.lit(k)) for k, g in enumerate(globs)])
    return files.withColumn("pattern_ord", order.cast("int")).where(F.col("pattern_ord").isNotNull() & ~matches_any(F.col("path"), exclude))


def distinct_paths(files: DataFrame) -> DataFrame:
    """One row for each path, that with the smallest ordinal; map-side combined."""
    return files.groupBy("path").agg(F.min_by(F.struct("lang", "text", "pattern_ord"), F.struct("pattern_ord", "text")).alias("f")).select("path", "f.*")


def variable_files(files: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """Files whose definitions make the index."""
    return glob_scan(files, SCAN_GLOBS if config.scan_all_files else config.variable_files, config.exclude)


def project_files(files: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """Files that a project scan visits: styles without sass, vue and html, and components."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]*)\z", 1))
    return files.where(ext.isin("css", "scss", "less", "tsx", "jsx") & ~matches_any(F.col("path"), config.exclude or ("**/node_modules/**",)))


def is_supported(config: AnalyzerConfig, path: Column | None = None, lang: Column | None = None) -> Column:
    """Whether a document is diagnosed: a known language, included, not excluded."""
    path, lang = F.col("path") if path is None else path, F.col("lang") if lang is None else lang
    included = matches_any(path, config.include) if config.include else F.lit(True)
    return lang.isin(*STYLE_LANGUAGES, *REACT_LANGUAGES) & included & ~matches_any(path, config.exclude)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
