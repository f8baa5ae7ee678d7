"""Reports as whole queries."""

from varloom.operators import diagnostics as diag
from varloom.plans.analyzer import Analyzer
from varloom.sources.files import files_from_table

TEXTS = [("/ws/variables.css", ":root{--brand: #3498db;}"), ("/ws/a.css", ".x{color: var(--brnd); font-size: 14px}\n.y{color: var(--gone)}"), ("/ws/b.css", ".x{color: var(--brand)}"), ("/ws/c.css", ".x{color: var(--none)}")]


def test_report_lines_find_once(spark, monkeypatch):
    made, real = [], diag.diagnostics
    monkeypatch.setattr(diag, "diagnostics", lambda *a: made.append(1) or real(*a))
    a = Analyzer(spark).load(files_from_table(spark.createDataFrame(TEXTS, "path string, text string")))
    lines = a.report_lines
    assert "generate" not in lines._jdf.queryExecution().optimizedPlan().toString().lower()  # neither text nor header parses again
    rows = {r["path"]: r["text"] for r in lines.collect()}
    assert sorted(rows, key=str) == ["/ws/a.css", "/ws/c.css", None] and len(made) == 1
    assert "Total diagnósticos: 4\nArchivos analizados: 4\nArchivos con problemas: 2\n" in rows[None]


def test_the_project_report_has_every_document_with_findings(spark):
    a = Analyzer(spark).load(files_from_table(spark.createDataFrame(TEXTS, "path string, text string")))
    rows = [(r["total_diagnostics"], r["files_analyzed"], r["files_with_problems"], r["path"], r["total"], r["errors"], r["warnings"], len(r["examples"])) for r in a.project_result.collect()]
    assert rows == [(4, 4, 2, "/ws/a.css", 3, 2, 1, 3), (4, 4, 2, "/ws/c.css", 1, 1, 0, 1)]
    none = Analyzer(spark).load(files_from_table(spark.createDataFrame(TEXTS[:1], "path string, text string"))).project_result.collect()
    assert [(r["total_diagnostics"], r["files_analyzed"], r["files_with_problems"], r["path"]) for r in none] == [(0, 1, 0, None)]
