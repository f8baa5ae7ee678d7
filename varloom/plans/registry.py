"""Registered queries over the derived style corpus, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.config import EXCLUDED, AnalyzerConfig
from varloom.functions import color, globs, text, values
from varloom.operators import diagnostics as diag
from varloom.operators import editor, fix, index, parse, report, suggest
from varloom.plans import corpus
from varloom.plans.analyzer import Analyzer
from varloom.plans.oracle import SQL as ORACLE_SQL
from varloom.sources.files import decoded, project_files
from varloom.sources.files import distinct_paths as distinct_files
from varloom.sources.shared import written
from varloom.streaming import changes, rediagnose

CONFIG = AnalyzerConfig()
RANGE = ["start_line", "start_col", "end_line", "end_col"]


def _a(spark: SparkSession, sf_dir: str) -> Analyzer:
    return Analyzer(spark, CONFIG).load(corpus.files(spark, sf_dir))


def _values(name: str, /, **columns):
    """A query that maps the varied values by columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.values(spark, sf_dir).select("case_id", *[c.alias(k) for k, c in columns.items()])

    query.__name__ = name
    return query


def _colors(name: str, /, **columns):
    """A query over the parsed colours of the varied values."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus.values(spark, sf_dir).select("case_id", "value", color.parse_color(F.col("value")).alias("c")).where("c is not null")
        return c.select("case_id", *[x.alias(k) for k, x in columns.items()])

    query.__name__ = name
    return query


def definitions(spark, sf_dir):
    return _a(spark, sf_dir).definitions.select("path", "name", "value", "line", "col", "is_color")


def definitions_per_file(spark, sf_dir):
    return index.definitions_per_file(_a(spark, sf_dir).definitions)


def variable_index(spark, sf_dir):
    return _a(spark, sf_dir).variables.select("name", "value", "path", "line", "col", "is_color")


def index_stats(spark, sf_dir):
    return _a(spark, sf_dir).index_stats.select("n_variables", "n_files")


def rules(spark, sf_dir):
    return _a(spark, sf_dir).rules.select("path", "rule_ord", "selector", "content", "rule_line", "rule_col")


def declarations(spark, sf_dir):
    return _a(spark, sf_dir).declarations.select("path", "rule_ord", "decl_ord", "selector", "property", "value", "is_definition", "prop_line", "prop_col", *RANGE)


def var_uses(spark, sf_dir):
    return _a(spark, sf_dir).uses.select("path", "rule_ord", "decl_ord", "use_ord", "property", "name", "fallback", *RANGE)


def rule_definitions(spark, sf_dir):
    return _a(spark, sf_dir).rule_definitions


def document_uses(spark, sf_dir):
    return parse.document_uses(_a(spark, sf_dir).styles)


def undefined_uses(spark, sf_dir):
    a = _a(spark, sf_dir)
    return diag.undefined_uses(a.uses, a.variables).select("path", "name", "start_line", "start_col")


def defined_uses(spark, sf_dir):
    a = _a(spark, sf_dir)
    return diag.defined_uses(a.uses, a.variables).select("path", "name", "start_line", "start_col")


def hardcoded_values(spark, sf_dir):
    return diag.hardcoded_values(_a(spark, sf_dir).declarations, CONFIG).select("path", "rule_ord", "decl_ord", "property", "value", *RANGE)


def hardcoded_fallbacks(spark, sf_dir):
    return diag.hardcoded_fallbacks(_a(spark, sf_dir).uses).select("path", "rule_ord", "decl_ord", "use_ord", "property", "fallback", *RANGE)


def inline_expressions(spark, sf_dir):
    return diag.inline_expressions(_a(spark, sf_dir).files, CONFIG).select("path", "ord", "message", *RANGE)


def inline_objects(spark, sf_dir):
    return diag.inline_objects(_a(spark, sf_dir).files, CONFIG).select("path", "ord", "message", *RANGE)


def diagnostics(spark, sf_dir):
    return _a(spark, sf_dir).diagnostics.select("path", "phase", "o0", "o1", "o2", "kind", "severity", "message", "value", "var_name", *RANGE)


def file_report(spark, sf_dir):
    return _a(spark, sf_dir).file_report.withColumn("examples", F.array_join("examples", "|"))


def project_report(spark, sf_dir):
    """The whole result of a scan: the totals and the report of each document with findings."""
    return _a(spark, sf_dir).project_result.withColumn("examples", F.array_join("examples", "|"))


def report_lines(spark, sf_dir):
    return _a(spark, sf_dir).report_lines


def report_quick_list(spark, sf_dir):
    return report.quick_list(_a(spark, sf_dir).file_report)


def resolved_variables(spark, sf_dir):
    return _a(spark, sf_dir).resolved.select("name", "found", "value", "resolved_value", "is_color")


def alias_chains(spark, sf_dir):
    return _a(spark, sf_dir).resolved.select("name", F.array_join("chain", " > ").alias("chain"), F.size("chain").alias("n"))


def resolution_stop_reason(spark, sf_dir):
    return _a(spark, sf_dir).resolved.groupBy("stop").agg(F.count("*").alias("n"))


def resolution_descriptions(spark, sf_dir):
    from varloom.operators.resolve import descriptions

    a = _a(spark, sf_dir)
    return descriptions(a.variables, a.resolved)


def similar_names_top3(spark, sf_dir):
    a = _a(spark, sf_dir)
    return suggest.similar_names(diag.undefined_uses(a.uses, a.indexed), a.indexed).withColumn("similarity", F.round("similarity", 6))


def suggest_for_value_top3(spark, sf_dir):
    a = _a(spark, sf_dir)
    return suggest.variables_for_values(corpus.values(spark, sf_dir), *a.kept).withColumn("score", F.round("score", 6))


def completions(spark, sf_dir):
    return _a(spark, sf_dir).completions(corpus.cursors(spark, sf_dir)).select("cursor_id", "mode", "rank", "label", F.col("relevance").cast("long").alias("relevance"), "sort_text")


def completion_details(spark, sf_dir):
    a = _a(spark, sf_dir)
    return editor.completion_details(a.variables, a.resolved, CONFIG)


def hover_similar_top3(spark, sf_dir):
    a = _a(spark, sf_dir)
    return editor.hover_similar(diag.undefined_uses(a.uses, a.variables), a.variables)


def hover(spark, sf_dir):
    return _a(spark, sf_dir).hover(corpus.cursors(spark, sf_dir))


def hover_missing(spark, sf_dir):
    a = _a(spark, sf_dir)
    return editor.hover_missing(diag.undefined_uses(a.uses, a.variables), a.variables)


def goto_definition(spark, sf_dir):
    return _a(spark, sf_dir).goto_definition(corpus.cursors(spark, sf_dir))


def variable_at_cursor(spark, sf_dir):
    return editor.variable_at_cursor(editor.cursor_lines(corpus.cursors(spark, sf_dir), corpus.files(spark, sf_dir))).select("cursor_id", "name", "start_col", "end_col")


def property_at_cursor(spark, sf_dir):
    return editor.property_at_cursor(editor.cursor_lines(corpus.cursors(spark, sf_dir), corpus.files(spark, sf_dir)))


def code_actions(spark, sf_dir):
    return _a(spark, sf_dir).code_actions


def autofix_text(spark, sf_dir):
    a = _a(spark, sf_dir)
    return fix.apply_actions(a.files, a.code_actions)


def autofix_summary(spark, sf_dir):
    a = _a(spark, sf_dir)
    return a.applied.agg(F.sum("n_fixes").alias("fixes"), F.count("*").alias("files")).join(a.autofix().project_report)


def glob_filter(spark, sf_dir):
    return corpus.values(spark, sf_dir).select("case_id", "path", globs.matches_any(F.col("path"), EXCLUDED).alias("excluded"))


def offset_to_position(spark, sf_dir):
    t, o = F.col("text"), F.expr("int(length(text) * 2 div 3)")
    return corpus.sheets(spark, sf_dir).select("path", text.line_of(t, o).alias("line"), text.column_of(t, o).alias("col"))


def position_to_offset(spark, sf_dir):
    return corpus.sheets(spark, sf_dir).select("path", text.offset_of(F.col("text"), F.lit(3), F.lit(5)).alias("offset"))


def line_text(spark, sf_dir):
    return corpus.sheets(spark, sf_dir).select("path", text.line_text(F.col("text"), F.lit(3)).alias("line"))


def search_by_name(spark, sf_dir):
    return index.search_by_name(_a(spark, sf_dir).variables, "PART-1").select("name", "value")


def search_by_keywords(spark, sf_dir):
    return index.search_by_keywords(_a(spark, sf_dir).variables, ["Old", "-19"]).select("name", "value")


def variables_by_usage(spark, sf_dir):
    a = _a(spark, sf_dir)
    return index.by_usage(index.with_use_counts(a.variables, a.styles)).select("name", "use_count", "rank")


def variables_quick_list(spark, sf_dir):
    return index.quick_list(_a(spark, sf_dir).variables)


def change_replay_index(spark, sf_dir):
    return changes.replay(corpus.changes(spark, sf_dir)).select("name", "value", "path")


def change_incremental_index(spark, sf_dir):
    """The feed in two batches, each applied to the definitions that the one before left."""
    feed = corpus.changes(spark, sf_dir)
    half = feed.agg(F.percentile_approx("seq", 0.5).alias("__half"))
    part = lambda later: feed.join(half, (F.col("seq") > F.col("__half")) if later else (F.col("seq") <= F.col("__half"))).drop("__half")
    before = changes.apply_batch(spark.createDataFrame([], changes.SCHEMA), part(False))
    return index.variable_index(changes.apply_batch(before, part(True))).select("name", "value", "path")


def change_rediagnose(spark, sf_dir):
    """Findings after a change, from those before and the documents that it touches."""
    before, (files, changed) = _a(spark, sf_dir), corpus.changed_files(spark, sf_dir)
    after = Analyzer(spark, CONFIG).load(files)
    stored, uses = written(diag.diagnostics(before.files, before.indexed, CONFIG), "findings"), written(rediagnose.name_uses(before.files), "uses")
    found = rediagnose.rediagnose(stored, uses, after.files, changed, before.indexed, after.indexed, CONFIG)
    return found.select("path", "phase", "o0", "o1", "o2", "kind", "severity", "message", "value", "var_name", *RANGE)


def parse_errors(spark, sf_dir):
    """Every seventh style sheet without its text."""
    files = corpus.files(spark, sf_dir).withColumn("text", F.when(~F.col("path").endswith("7.css"), F.col("text")))
    return Analyzer(spark, CONFIG).load(files).parse_errors


def unreadable_files(spark, sf_dir):
    """Bytes of all documents, those of some sheets with one that is no UTF-8: these count as analysed and cannot be parsed."""
    content = F.when(F.col("path").endswith("9.css"), F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    a = Analyzer(spark, CONFIG).load(corpus.files(spark, sf_dir).withColumn("text", decoded(content)))
    return a.parse_errors.join(project_files(a.files, CONFIG).agg(F.countDistinct("path").alias("files_analyzed")))


def color_info(spark, sf_dir):
    return _a(spark, sf_dir).color_info.select("name", "color.format", "color.r", "color.g", "color.b", F.round("color.a", 6).alias("a"), "color.hex")


def distinct_paths(spark, sf_dir):
    """A scan whose globs list the style sheets twice."""
    files = corpus.files(spark, sf_dir)
    again = files.where(F.col("path").endswith(".css")).withColumn("pattern_ord", F.lit(1))
    return distinct_files(files.unionByName(again)).select("path", "lang", "pattern_ord", F.length("text").alias("n_chars"))


def variable_index_all_files(spark, sf_dir):
    """The index over all style sheets, not those of variables alone."""
    a = Analyzer(spark, AnalyzerConfig(scan_all_files=True)).load(corpus.files(spark, sf_dir))
    return a.variables.select("name", "value", "path", "line", "col", "is_color")


QUERIES = {
    f.__name__: f
    for f in (
        definitions, definitions_per_file, variable_index, index_stats, rules, declarations, var_uses, rule_definitions, document_uses, undefined_uses, defined_uses, hardcoded_values, hardcoded_fallbacks,
        inline_expressions, inline_objects, diagnostics, file_report, project_report, report_lines, report_quick_list, resolved_variables, alias_chains, resolution_stop_reason, resolution_descriptions,
        similar_names_top3, suggest_for_value_top3, completions, completion_details, hover_similar_top3, hover, hover_missing, goto_definition, variable_at_cursor, property_at_cursor,
        code_actions, autofix_text, autofix_summary, glob_filter, offset_to_position, position_to_offset, line_text, search_by_name, search_by_keywords, variables_by_usage, variables_quick_list, change_replay_index,
        change_incremental_index, change_rediagnose, parse_errors, unreadable_files, color_info, distinct_paths, variable_index_all_files,
    )
}


def _column_queries() -> dict:
    """Queries of one projection each; columns are made on first use, when a session is there."""
    made = {
        "is_color": lambda: _values("is_color", is_color=color.is_color(F.col("value"))),
        "is_hardcoded": lambda: _values("is_hardcoded", is_hardcoded=values.is_hardcoded(F.col("value"))),
        "value_kind": lambda: _values("value_kind", kind=values.value_kind(F.col("value"))),
        "normalize_value": lambda: _values("normalize_value", normalized=values.normalize_value(F.col("value"))),
        "clean_value": lambda: _values("clean_value", cleaned=values.clean_value(F.col("value"))),
        "split_compound": lambda: _values("split_compound", parts=F.array_join(values.split_compound(F.col("value")), "|")),
        "property_gate": lambda: _values("property_gate", checked=values.property_checked(F.col("property"), CONFIG)),
        "allowed_value": lambda: _values("allowed_value", allowed=values.is_allowed(F.col("value"), CONFIG)),
        "property_class": lambda: _values("property_class", **{"class": values.property_class(F.col("property"))}),
        "definition_name": lambda: _values("definition_name", name=values.definition_name(F.col("property"))),
        "css_extension": lambda: _values("css_extension", extension=globs.extension(F.col("path")), is_style=globs.is_style_file(F.col("path"))),
        "relative_path": lambda: _values("relative_path", relative=globs.relative_path(F.col("path"), ["/ws"])),
        "string_hash": lambda: _values("string_hash", hash=text.string_hash(F.col("path"))),
        "parse_color": lambda: _colors("parse_color", format=F.col("c.format"), r=F.col("c.r"), g=F.col("c.g"), b=F.col("c.b"), a=F.round("c.a", 6), hex=F.col("c.hex")),
        "contrast": lambda: _colors("contrast", contrast=F.round(color.contrast(F.col("c"), F.struct(*[F.lit(255).alias(k) for k in "rgb"])), 6)),
        "nearest_named_color": lambda: _colors("nearest_named_color", name=color.nearest_name(F.col("c"))),
        "color_preview": lambda: _colors("color_preview", markdown=color.preview_markdown(F.col("c"))),
    }

    def lazy(make):
        return lambda spark, sf_dir: make()(spark, sf_dir)

    return {name: lazy(make) for name, make in made.items()}


QUERIES |= _column_queries()
