"""The analysis of one corpus as lazily built tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.config import ACTION_LANGUAGES, AnalyzerConfig
from varloom.functions.sql import register_functions
from varloom.operators import diagnostics as diag
from varloom.operators import editor, fix, index, parse, report, resolve, suggest
from varloom.sources.buckets import BucketTable, bucket_of
from varloom.sources.files import distinct_paths, files_from_table, is_supported, project_files, read_files, variable_files
from varloom.sources.shared import written


class Analyzer:
    """Tables of a corpus: ``Analyzer(spark).load(files).project_report``.

    Every table is a plan; nothing runs until it is asked for. persist() keeps
    the index and the resolved table, which most others use.
    """

    def __init__(self, spark: SparkSession, config: AnalyzerConfig | None = None):
        self.spark, self.config = spark, config or AnalyzerConfig()
        self.files: DataFrame | None = None
        self._kept: list[DataFrame] = []

    def load(self, files: DataFrame) -> Analyzer:
        """Take a table of path and text, lang and pattern_ord optional; paths should be distinct."""
        self.refresh()
        self.files = files_from_table(files)
        return self

    def load_path(self, root: str) -> Analyzer:
        return self.load(distinct_paths(read_files(self.spark, root)))

    def refresh(self) -> None:
        """Forget all tables and what persist() kept."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        for name in [k for k, v in vars(type(self)).items() if isinstance(v, cached_property)]:
            self.__dict__.pop(name, None)

    def persist(self) -> Analyzer:
        self._kept += [self.variables.persist(), self.resolved.persist()]
        return self

    @cached_property
    def scanned(self) -> DataFrame:
        return variable_files(self.files, self.config)

    @cached_property
    def definitions(self) -> DataFrame:
        return parse.definitions(self.scanned)

    @cached_property
    def variables(self) -> DataFrame:
        found = index.variable_index(self.definitions)
        return index.with_use_counts(found, self.files) if self.config.count_uses else found

    @cached_property
    def index_stats(self) -> DataFrame:
        return index.index_stats(self.variables, self.scanned)

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve.resolve(self.variables)

    @cached_property
    def indexed(self) -> DataFrame:
        """The index, written so that the documents are parsed once however often it is read."""
        return written(self.variables, "variables")

    @cached_property
    def kept(self) -> tuple[DataFrame, DataFrame]:
        """The written index and what resolves from it."""
        return self.indexed, resolve.resolve(self.indexed)

    @cached_property
    def styles(self) -> DataFrame:
        return self.files.where(is_supported(self.config) & ~self.files["lang"].isin("typescriptreact", "javascriptreact"))

    @cached_property
    def rules(self) -> DataFrame:
        return parse.rules(self.styles)

    @cached_property
    def declarations(self) -> DataFrame:
        return parse.declarations(self.rules)

    @cached_property
    def uses(self) -> DataFrame:
        """var() calls of all declarations; rules and declarations that have none are not placed."""
        return parse.var_uses(parse.declarations(parse.rules(self.styles, parse.may_call), parse.may_call))

    @cached_property
    def rule_definitions(self) -> DataFrame:
        """Definitions of the full parse; only they are placed."""
        begins = lambda text: F.startswith(text, F.lit("--"))
        return parse.rule_definitions(parse.declarations(parse.rules(self.styles, lambda content: F.contains(content, F.lit("--"))), begins))

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Findings of every supported document."""
        return diag.diagnostics(self.files, self.variables, self.config)

    @cached_property
    def project_diagnostics(self) -> DataFrame:
        """Findings of the documents that a project scan visits."""
        return diag.diagnostics(project_files(self.files, self.config), self.variables, self.config)

    @cached_property
    def file_report(self) -> DataFrame:
        return report.file_report(self.project_diagnostics)

    @cached_property
    def project_report(self) -> DataFrame:
        return report.project_totals(self.project_diagnostics, project_files(self.files, self.config))

    @cached_property
    def project_result(self) -> DataFrame:
        """The whole result of a project scan, in the order of ordered_report; the report of each document is written once."""
        found = written(self.file_report, "report")
        return report.ordered_report(report.project_result(found, report.report_totals(found, project_files(self.files, self.config))))

    @cached_property
    def ordered_report(self) -> DataFrame:
        return report.ordered_report(self.file_report)

    @cached_property
    def parse_errors(self) -> DataFrame:
        return parse.parse_errors(self.files)

    @cached_property
    def color_info(self) -> DataFrame:
        return resolve.color_info(self.resolved)

    @cached_property
    def report_lines(self) -> DataFrame:
        """The report as text; that of each document is written once, since the header adds it up."""
        found = written(self.file_report, "report")
        return report.report_lines(found, report.report_totals(found, project_files(self.files, self.config)))

    @cached_property
    def code_actions(self) -> DataFrame:
        """Quick fixes for the languages that have them; findings and index are written once, since each kind of fix reads them several times."""
        known = self.files.where(self.files["lang"].isin(*ACTION_LANGUAGES))
        index, resolved = self.kept
        return suggest.code_actions(written(diag.diagnostics(known, index, self.config), "findings"), known, index, resolved)

    @cached_property
    def applied(self) -> DataFrame:
        """path, text, n_fixes of the documents that fixes change; written once, since a second analysis reads them many times."""
        return written(fix.apply_actions(self.files, self.code_actions), "fixes")

    @cached_property
    def fixed_files(self) -> DataFrame:
        return fix.fixed_files(self.files, self.applied)

    def autofix(self) -> Analyzer:
        """The analysis of the corpus after its fixes."""
        return Analyzer(self.spark, self.config).load(self.fixed_files)

    def completions(self, cursors: DataFrame) -> DataFrame:
        contexts = editor.completion_contexts(editor.cursor_lines(cursors, self.files, editor.COMPLETION))
        return editor.completions(contexts, *self.kept, self.config)

    def hover(self, cursors: DataFrame) -> DataFrame:
        return editor.hover(cursors, self.files, self.variables, self.resolved, self.config)

    def goto_definition(self, cursors: DataFrame) -> DataFrame:
        return editor.goto_definition(editor.cursor_lines(cursors, self.files), self.variables)

    def write_diagnostics(self, path: str) -> DataFrame:
        """Put the findings of the documents at hand in the place of their former ones and return the table.

        Documents that now have none lose theirs; those not at hand keep theirs.
        """
        found = self.diagnostics
        table = BucketTable(self.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema))
        own = self.files.where("path is not null").select("path").distinct()
        touched = [r[0] for r in own.select(bucket_of(own["path"]).alias("b")).distinct().collect()]  # at most as many as buckets
        if touched:
            table.replace(table.read(touched).join(own, "path", "left_anti").unionByName(found), touched)
        return table.read()

    def register_views(self, prefix: str = "css_") -> None:
        """Temporary views of the main tables and the SQL functions."""
        for name in ("files", "definitions", "variables", "resolved", "rules", "declarations", "uses", "diagnostics", "file_report", "project_report"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        register_functions(self.spark, prefix)
