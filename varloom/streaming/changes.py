"""Incremental maintenance of definitions from a change feed.

A feed has seq, path, op (upsert, delete, reset) and text. A reset drops all
that came before it. The index is recomputed exactly after each batch: a
definition that another file had shadowed comes forward when its winner goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varloom.operators.index import variable_index
from varloom.operators.parse import definitions
from varloom.sources.buckets import BUCKETS, BucketTable, bucket_of
from varloom.sources.files import files_from_table

SCHEMA = "path string, pattern_ord int, name string, value string, line int, col int, offset int, is_color boolean"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path after the last reset, map-side combined; ties keep the greater operation and text."""
    reset = changes.where(F.col("op") == "reset").agg(F.max("seq").alias("__reset"))
    own = changes.where(F.col("op") != "reset").groupBy("path").agg(F.max(F.struct("seq", "op", "text")).alias("c"))
    return own.join(reset).where(F.col("__reset").isNull() | (F.col("c.seq") > F.col("__reset"))).select("path", "c.seq", "c.op", "c.text")


def replay(changes: DataFrame) -> DataFrame:
    """The index that a whole feed leaves."""
    live = latest(changes).where(F.col("op") == "upsert")
    return variable_index(definitions(files_from_table(live.select("path", "text"))))


def apply_batch(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Definitions after a batch of changes; paths that the batch does not name keep theirs, unless it has a reset."""
    last = latest(changes)
    has_reset = changes.where(F.col("op") == "reset").limit(1).select(F.lit(True).alias("__all"))
    kept = current.join(last.select("path"), "path", "left_anti").join(has_reset, F.lit(True), "left").where("__all is null").drop("__all")
    new = definitions(files_from_table(last.where(F.col("op") == "upsert").select("path", "text")))
    return kept.unionByName(new)


class DefinitionStream:
    """Keeps a definitions table, by buckets of the path, in step with a feed.

    A batch replaces only the buckets of the paths it names; a reset replaces
    all. Batches are idempotent, so one that is tried again leaves the same table.
    """

    def __init__(self, spark: SparkSession, table: str, checkpoint: str):
        self.table, self.checkpoint = BucketTable(spark, table, SCHEMA), checkpoint

    def current(self) -> DataFrame:
        return self.table.read()

    def index(self) -> DataFrame:
        return variable_index(self.current())

    def _batch(self, changes: DataFrame, _: int) -> None:
        changes = changes.persist()
        try:
            if not changes.where(F.col("op") == "reset").isEmpty():
                self.table.replace(apply_batch(self.table.read([]), changes), list(range(BUCKETS)))
                return
            touched = [r[0] for r in changes.where("path is not null").select(bucket_of(F.col("path")).alias("b")).distinct().collect()]  # at most BUCKETS
            if touched:
                self.table.replace(apply_batch(self.table.read(touched), changes), touched)
        finally:
            changes.unpersist()

    def start(self, feed: DataFrame, once: bool = False) -> StreamingQuery:
        """Follow a streaming feed; changes of half a second come together."""
        writer = feed.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
