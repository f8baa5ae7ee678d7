"""Shared plumbing: tables in the shared folder, batch sizes, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests) a temporary folder is made
    once and set on the session; on a cluster that is an error, since executors
    would write to folders that the others do not see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/varloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`shared_path`; nothing may still read it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut lineage with a parquet table in the shared folder, which outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.table_path)
        _written.remove(t.table_path)


#: Bytes of an Arrow batch; several copies of it are held on both sides.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts or sets small enough for a Python worker, by rows and by bytes; a row is never split."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_state: dict = {}


def worker_state(key: object, make: Callable[[], object] = lambda: None) -> object:
    """What an operator keeps in a Python worker from task to task; a worker keeps one operator's at a time."""
    if not _state or _state["key"] != key:
        _state.clear()
        trim()
        _state.update(key=key, value=make())
    return _state["value"]


def trim() -> None:
    """Give memory that Python and Arrow hold without need back to the system, where it can be done."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Edges that one task may join: sixteen bytes each.
LOCAL_EDGES = 1_000_000


def _join_locally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all the edges of a task, each named by its smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]}, dtype="int64")


def connected_components(edges: DataFrame, max_rounds: int = 40, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Components of an undirected graph given as long columns ``a``, ``b``.

    Returns ``node, component``: one row for each node of an edge, with the
    smallest node it reaches. Alternates large-star and small-star steps, each a
    map-side combined ``min`` and one equi-join, so no neighbourhood is ever
    gathered; every round is written to the shared folder. As soon as at most
    local_edges edges are left, a count that is checked, one task finishes
    them. Null ends and loops are ignored; an empty graph gives no rows.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame) -> DataFrame:
        """Each a keeps its smallest neighbour m (or itself); e must list a's neighbours b."""
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return e.join(least, "a")

    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "cc")
    before = None
    for _ in range(max_rounds):
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n <= local_edges:
            done = materialise(e.repartition(1).mapInPandas(_join_locally, "node long, component long"), "cc")
            discard(e)
            return done
        if (n, total) == before:
            break
        before = (n, total)
        large = star(both(e)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = star(large)
        last, e = e, materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
