"""Streams and stored tables: keyed state, bursts and late edits, restarts, re-diagnosis, writers that collide."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from varloom.plans.analyzer import Analyzer
from varloom.sources.buckets import BucketTable, bucket_of
from varloom.sources.files import files_from_table
from varloom.streaming.keyed import IndexStream, read_settled, settled, write_settled
from varloom.streaming.rediagnose import FindingsStore, affected, changed_names, name_uses, rediagnose

SCHEMA = "seq long, path string, op string, text string, ts timestamp"
START = datetime(2024, 5, 1)


def rows(*changes):
    return [(seq, path, op, text, START + timedelta(milliseconds=ms)) for seq, path, op, text, ms in changes]


def feed(spark, folder, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_index_as_keyed_state(spark, tmp_path):
    source, table, state = (str(tmp_path / k) for k in ("feed", "table", "state"))
    index = lambda: {r["name"]: (r["value"], r["path"], r["line"], r["col"], r["is_color"]) for r in IndexStream(spark, table, state).index().collect()}

    def follow(*changes):  # a new stream object each time: a restart from the checkpoint
        part = rows(*changes)
        tick = (10**6 + changes[-1][0], "/tick", "delete", None, part[-1][4] + timedelta(minutes=1))
        for batch in (part, [tick]):
            write_settled(feed(spark, source, batch), f"{source}-settled", f"{state}-settled", once=True).awaitTermination()
        IndexStream(spark, table, state).start(read_settled(spark, f"{source}-settled"), once=True).awaitTermination()
        return index()

    got = follow((1, "/b.css", "upsert", "a{--x: red;\n --y: 2px; --y: 3px;}", 0), (2, "/a.css", "upsert", "a{--x: 1px;}", 900), (3, "/c.css", "upsert", "a{--x: 9px; --z: 4px;}", 1800))
    assert got == {"--x": ("1px", "/a.css", 0, 2, False), "--y": ("2px", "/b.css", 1, 1, False), "--z": ("4px", "/c.css", 0, 12, False)}
    # the winner goes, the shadowed one comes forward; a name leaves a path, another changes its value
    got = follow((4, "/a.css", "delete", None, 120_000), (5, "/c.css", "upsert", "a{--x: 9px; --w: 5px;}", 121_000))
    assert got == {"--x": ("red", "/b.css", 0, 2, True), "--y": ("2px", "/b.css", 1, 1, False), "--w": ("5px", "/c.css", 0, 12, False)}
    # a reset drops all before it, also what shadows a later definition
    got = follow((6, None, "reset", None, 240_000), (7, "/z.css", "upsert", "a{--x: 7px;}", 241_000))
    assert got == {"--x": ("7px", "/z.css", 0, 2, False)}
    got = follow((8, "/b.css", "upsert", "a{--x: 8px;}", 360_000))
    assert got == {"--x": ("8px", "/b.css", 0, 2, False)}
    assert follow((9, "/b.css", "upsert", None, 480_000)) == {"--x": ("7px", "/z.css", 0, 2, False)}


def test_bursts_and_late_edits(spark, tmp_path):
    source, out, state = (str(tmp_path / k) for k in ("feed", "out", "state"))

    def follow(part):
        settled(feed(spark, source, rows(*part))).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["path"], r["seq"]) for r in spark.read.parquet(out).collect())

    burst = [(k, "/a.css", "upsert", str(k), 300 * k) for k in range(1, 8)]  # each within half a second of the one before
    apart = [(8, "/a.css", "upsert", "8", 2700), (9, "/b.css", "upsert", "9", 2100)]
    assert follow([*reversed(burst), *apart]) == []  # the watermark has not passed them
    assert follow([(10, "/c.css", "upsert", "10", 30_000)]) == [("/a.css", 7), ("/a.css", 8), ("/b.css", 9)]
    late = [(11, "/a.css", "upsert", "11", 1000), (12, "/b.css", "upsert", "12", 25_000)]  # past the watermark; late but before it
    assert follow([*late, (13, "/d.css", "upsert", "13", 90_000)]) == [("/a.css", 7), ("/a.css", 8), ("/b.css", 9), ("/b.css", 12), ("/c.css", 10)]


SHEETS = {"/v.css": ":root{--a: red; --b: 1px;}", "/one.css": ".x{color: var(--a)}", "/two.css": ".x{color: var(--c); margin: var(--b)}", "/three.css": ".x{font-size: 3px}", "/four.css": ".x{color: var(--d)}", "/gone.css": ".x{color: var(--zz)}"}
AFTER = {k: v for k, v in SHEETS.items() if k != "/gone.css"} | {"/v.css": ":root{--b: 2px; --c: blue;}", "/four.css": ".x{color: var(--a)}", "/new.css": ".x{color: var(--q)}"}
CHANGED = ["/v.css", "/four.css", "/gone.css", "/new.css"]


def analysis(spark, texts):
    files = files_from_table(spark.createDataFrame(list(texts.items()), "path string, text string")).withColumn("path", F.concat(F.lit("/ws"), "path"))
    variables = files.where(F.col("path") == "/ws/v.css").withColumn("path", F.lit("/ws/variables.css"))
    return Analyzer(spark).load(files.where(F.col("path") != "/ws/v.css").unionByName(variables))


def moved_paths(spark):
    return spark.createDataFrame([("/ws" + p.replace("/v.css", "/variables.css"),) for p in CHANGED], "path string")


def found(df):
    return sorted((r["path"], r["kind"], r["var_name"] or r["value"], r["start_line"], r["start_col"]) for r in df.collect())


def test_rediagnosis_touches_what_a_change_affects(spark):
    before, after, changed = analysis(spark, SHEETS), analysis(spark, AFTER), moved_paths(spark)
    names, uses = changed_names(before.variables, after.variables), name_uses(before.files)
    assert sorted(r["name"] for r in names.collect()) == ["--a", "--c"]
    assert {r["path"] for r in affected(changed, names, uses).collect()} == {"/ws/variables.css", "/ws/four.css", "/ws/gone.css", "/ws/new.css", "/ws/one.css", "/ws/two.css"}
    got = rediagnose(before.diagnostics, uses, after.files, changed, before.variables, after.variables, after.config)
    assert found(got) == found(after.diagnostics)


def test_findings_store(spark, tmp_path):
    store = FindingsStore(spark, str(tmp_path / "store"))
    before, after = analysis(spark, SHEETS), analysis(spark, AFTER)
    none = before.variables.where("false")
    store.update(before.files, before.files.select("path"), none, before.variables)
    assert found(store.findings.read()) == found(before.diagnostics)
    versions = store.findings.current()
    store.update(after.files, moved_paths(spark), before.variables, after.variables)
    assert found(store.findings.read()) == found(after.diagnostics)
    assert sorted(map(tuple, store.uses.read().collect())) == sorted(map(tuple, name_uses(after.files).collect()))
    untouched = spark.createDataFrame([("/ws/three.css",)], "path string").select(bucket_of(F.col("path"))).first()[0]
    if untouched not in {b for b, v in store.findings.current().items() if v > max(versions.values())}:
        assert store.findings.current()[untouched] == versions[untouched]


def test_writers_that_collide(spark, tmp_path):
    schema = "path string, n int"
    one = lambda p, n: spark.createDataFrame([(p, n)], schema)
    bucket = one("/a", 1).select(bucket_of(F.col("path"))).first()[0]
    first, second = BucketTable(spark, str(tmp_path), schema), BucketTable(spark, str(tmp_path), schema)
    first.read(), second.read()
    first.replace(one("/a", 1), [bucket])
    with pytest.raises(RuntimeError, match="another writer"):
        second.replace(one("/a", 2), [bucket])
    assert [tuple(r) for r in second.read().collect()] == [("/a", 1)]
    second.replace(one("/a", 2), [bucket])  # read again
    assert [tuple(r) for r in first.read().collect()] == [("/a", 2)]
