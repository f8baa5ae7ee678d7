"""A change diagnoses from written indexes, and looks up names without places."""

from pyspark.sql import functions as F

from varloom.operators import parse
from varloom.sources.files import files_from_table
from varloom.streaming.rediagnose import name_uses


def test_name_uses_without_places(spark):
    texts = [("/ws/a.css", ".x{color: var(--a); fill: var( --b , var(--c))} /* var(--d) var(--a) */"), ("/ws/b.css", ".x{color: red}"), ("/ws/c.css", None), ("/ws/e.css", "var(x) var(--é)"), ("/ws/d.tsx", "var(--a)"), (None, "var(--z)")]
    f = files_from_table(spark.createDataFrame(texts, "path string, text string"))
    found = name_uses(f)
    every = parse.document_uses(f.where(~F.col("lang").isin("typescriptreact", "javascriptreact"))).select("name", "path").distinct()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, every.collect()), key=str) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "aggregate(" not in plan
