"""The index as keyed state of a stream: debounced edits, definitions by path, candidates by name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from varloom.functions.color import is_color
from varloom.functions.text import let, matches
from varloom.functions.values import clean_value
from varloom.operators.parse import DEFINITION
from varloom.sources.buckets import BucketTable, bucket_of

DEFINED = "value string, pattern_ord int, offset int, line int, col int, is_color boolean"
DELTA = f"name string, path string, seq long, live boolean, {DEFINED}"
CANDIDATE = f"name string, path string, seq long, {DEFINED}"
FIELDS = [f.split()[0] for f in DEFINED.split(", ")]
#: The state store that keyed state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(feed: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last change of each burst: edits of a path that follow each other within gap are one session in event time.

    feed: seq, path, op, text and ts. A burst is passed on once the watermark,
    late behind the newest edit, has passed its end; edits that come later still
    are left out, as by any watermark. A reset is a change without a path.
    """
    burst = feed.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.max(F.struct("seq", "op", "text")).alias("c"))
    return burst.select("path", "c.seq", "c.op", "c.text")


SETTLED = "path string, seq long, op string, text string"


def write_settled(feed: DataFrame, folder: str, checkpoint: str, once: bool = False, gap: str = "500 milliseconds", late: str = "10 seconds") -> StreamingQuery:
    """Write settled changes to a folder, each once, for an IndexStream to follow: read_settled gives them as a stream."""
    writer = settled(feed, gap, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", folder)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def read_settled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SETTLED).parquet(folder)


def _definitions(text: Column) -> Column:
    """array<struct> of the first definition of each name in a text, as columns FIELDS and name."""

    def of(m: Column) -> Column:
        value = clean_value(F.regexp_extract(m["match"], DEFINITION, 2))
        return let(value, lambda v: F.struct(F.regexp_extract(m["match"], DEFINITION, 1).alias("name"), v.alias("value"), F.lit(0).alias("pattern_ord"), m["offset"].alias("offset"), m["line"].alias("line"), m["col"].alias("col"), is_color(v).alias("is_color")))

    return F.transform(matches(text, DEFINITION), of)


class _ByPath(StatefulProcessor):
    """State of a path: its last change and the names it defines. Gives what each change puts in and takes out."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.names = handle.getMapState("names", "name string", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            for r in batch.itertuples(index=False):
                if newest is None or r.seq > newest.seq:
                    newest = r
        before = self.last.get()
        if newest is None or (before is not None and before[0] >= newest.seq):
            return
        seq = int(newest.seq)
        self.last.update((seq,))
        out, found = [], {}
        if key[0] is None:  # a reset goes on under no name
            out.append((None, None, seq, False, *[None] * len(FIELDS)))
        elif newest.op == "upsert" and newest.defs is not None:
            for d in newest.defs:
                if d["name"] not in found or d["offset"] < found[d["name"]]["offset"]:
                    found[d["name"]] = d
        for name in [k[0] for k in self.names.keys()]:
            if name not in found:
                self.names.removeKey((name,))
                out.append((name, key[0], seq, False, *[None] * len(FIELDS)))
        for name, d in found.items():
            self.names.updateValue((name,), (seq,))
            out.append((name, key[0], seq, True, *[d[f] for f in FIELDS]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DELTA.split(", ")]).astype({"pattern_ord": "Int64", "offset": "Int64", "line": "Int64", "col": "Int64", "is_color": "boolean"})

    def close(self) -> None:
        pass


class _ByName(StatefulProcessor):
    """State of a name: its definition in each path. Gives the definitions that can be the first one.

    A reset reaches no key; whatever is older than the last one does not count.
    So all definitions are given that are first among those not older than
    themselves: after a reset the first of these that is newer wins.
    """

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "path string", f"seq long, {DEFINED}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for r in batch.sort_values("seq").itertuples(index=False):
                if key[0] is None:
                    out.append((None, None, int(r.seq), *[None] * len(FIELDS)))
                elif r.live:
                    self.known.updateValue((r.path,), (int(r.seq), r.value, int(r.pattern_ord), int(r.offset), int(r.line), int(r.col), bool(r.is_color)))
                else:
                    self.known.removeKey((r.path,))
        if key[0] is not None:
            newest = -1
            for path, d in sorted(((k[0], v) for k, v in self.known.iterator()), key=lambda x: (x[1][2], x[0], x[1][3])):
                if d[0] > newest:
                    newest = d[0]
                    out.append((key[0], path, *d))
            if not out:  # the name has gone
                out.append((key[0], None, None, *[None] * len(FIELDS)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATE.split(", ")]).astype({"seq": "Int64", "pattern_ord": "Int64", "offset": "Int64", "line": "Int64", "col": "Int64", "is_color": "boolean"})

    def close(self) -> None:
        pass


class IndexStream:
    """Keeps the index of a feed up to date: work follows the names that a change touches, not all definitions.

    What a path defines and who defines a name are state of the stream; a batch
    hands on only names that changed, and only their buckets of the table are
    replaced. A batch that is tried again leaves the same table.
    """

    def __init__(self, spark: SparkSession, table: str, checkpoint: str):
        self.spark, self.table, self.checkpoint = spark, BucketTable(spark, table, CANDIDATE, key="name"), checkpoint

    def index(self) -> DataFrame:
        """name, value, path, line, col, offset, is_color, pattern_ord of the first definition of each name since the last reset."""
        rows = self.table.read()
        reset = rows.where("name is null").agg(F.max("seq").alias("__reset"))
        live = rows.where("path is not null").join(reset).where(F.col("__reset").isNull() | (F.col("seq") > F.col("__reset")))
        first = F.min_by(F.struct("value", "path", "line", "col", "offset", "is_color", "pattern_ord"), F.struct("pattern_ord", "path", "offset"))
        return live.groupBy("name").agg(first.alias("v")).select("name", "v.*")

    def _batch(self, changed: DataFrame, _: int) -> None:
        changed = changed.persist()
        try:
            hit = [r[0] for r in changed.select(bucket_of(F.col("name")).alias("b")).distinct().collect()]  # at most as many as buckets
            if hit:
                kept = self.table.read(hit).join(changed.select("name").distinct(), "name", "left_anti")  # rows without a name stay
                self.table.replace(kept.unionByName(changed.where("path is not null or name is null")).distinct(), hit)
        finally:
            changed.unpersist()

    def start(self, changes: DataFrame, once: bool = False) -> StreamingQuery:
        """Follow a stream of seq, path, op and text; of changes of a path that come out of order the greatest seq counts."""
        changes = changes.select("path", "seq", "op", F.when(F.col("op") == "upsert", _definitions(F.coalesce("text", F.lit("")))).alias("defs"))
        deltas = changes.groupBy("path").transformWithStateInPandas(_ByPath(), DELTA, "Append", "None")
        candidates = deltas.groupBy("name").transformWithStateInPandas(_ByName(), CANDIDATE, "Append", "None")
        before = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        try:
            writer = candidates.writeStream.foreachBatch(self._batch).outputMode("append").option("checkpointLocation", self.checkpoint)
            return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
        finally:
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
