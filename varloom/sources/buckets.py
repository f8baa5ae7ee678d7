"""Tables kept by bucket of a key, replaced bucket by bucket without a moment in which rows are gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def bucket_of(path: Column) -> Column:
    return F.pmod(F.hash(path), F.lit(BUCKETS))


class BucketTable:
    """Rows of a schema under <path>/data/version=V/bucket=B; <path>/commits/V names the buckets that version V replaced.

    A replacement writes new files first and its commit last. Readers take each
    bucket from its last committed version, so a write that breaks off changes
    nothing. Files that two later versions have replaced are deleted. Of two
    writers of the same buckets the second to finish fails and has to read again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "path"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.jvm = spark._jvm
        self.seen = 0

    def _fs(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def commits(self) -> dict[int, list[int]]:
        """Buckets of each committed version; at most BUCKETS numbers each, read from names of empty files."""
        if not self._exists(f"{self.path}/commits"):
            return {}
        fs, where = self._fs(f"{self.path}/commits")
        out: dict[int, list[int]] = {}
        for f in fs.listStatus(where):
            version, _, buckets = f.getPath().getName().partition("-")
            out[int(version)] = [int(b, 16) for b in (buckets.split(".") if buckets else [])]
        return out

    def current(self) -> dict[int, int]:
        """The version of each bucket that has one."""
        return {b: v for v, buckets in sorted(self.commits().items()) for b in buckets}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        current = self.current()
        self.seen = max(current.values(), default=0)
        live = [(v, b) for b, v in current.items() if buckets is None or b in buckets]
        fields = T.StructType([*T._parse_datatype_string(self.schema).fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
        paths = [p for p in (f"{self.path}/data/version={v}/bucket={b}" for v, b in live) if self._exists(p)]  # a bucket without rows has no folder
        if not paths:
            return self.spark.createDataFrame([], fields).drop("version", "bucket")
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/data").parquet(*paths).drop("version", "bucket")

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Make rows of the schema all that these buckets hold; rows of other buckets must not occur.

        Raises where another writer has replaced one of them since this table was
        last read.
        """
        commits = self.commits()
        version = max(commits, default=0) + 1
        while True:  # a number of its own for each writer, also where another broke off
            fs, where = self._fs(f"{self.path}/claims/{version:012d}")
            if fs.createNewFile(where):
                break
            version += 1
        data = f"{self.path}/data/version={version}"
        rows.withColumn("bucket", bucket_of(F.col(self.key))).write.mode("overwrite").partitionBy("bucket").parquet(data)
        done = set(buckets)
        newer = {v for v, bs in self.commits().items() if v > self.seen and done & set(bs)}
        if newer:  # what was read is no longer what the buckets hold
            raise RuntimeError(f"{self.path}: another writer has replaced the same buckets; read again and retry")
        fs, where = self._fs(f"{self.path}/commits/{version:012d}-{'.'.join(format(b, 'x') for b in sorted(done))}")
        fs.create(where, False).close()
        self.seen = version
        last: dict[int, list[int]] = {}
        for v, bs in sorted(commits.items()):
            for b in bs:
                last.setdefault(b, []).append(v)
        for b in done:  # what was current stays for those who read it
            for v in last.get(b, [])[:-1]:
                fs, where = self._fs(f"{self.path}/data/version={v}/bucket={b}")
                fs.delete(where, True)
