"""Keyed tables merged on read (SNK-1 storage): plain Parquet runs and one empty marker file a batch.

Batch ``n`` appends one run, ``<table>/lo=<n>/size=1``, with its own rows only; a reader takes the
latest row of each key.  When a batch completes ``FAN`` ** k batches, their runs are folded into one.  So the runs
that are live after batch ``n`` follow from the digits of ``n + 1`` (fewer than ``FAN`` a level), a row is rewritten
once a level, and no list of files is kept.  The marker ``<root>/_done/<n>`` covers all tables and output folders
of the batch and is made last: without it a replay writes the same folders again.  Runs and markers
that went out of use ``KEEP`` batches ago are removed, so both stay few however old the stream is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN, KEEP = 8, 8


def overwrite(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as the whole content of ``path``, whatever the session's overwrite mode is."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def live(batches: int) -> list[tuple[int, int]]:
    """(first batch, number of batches) of the runs that hold the first ``batches`` batches."""
    out, lo, size = [], 0, 1
    while size * FAN <= batches:
        size *= FAN
    while lo < batches:
        while lo + size > batches:
            size //= FAN
        out.append((lo, size))
        lo += size
    return out


class Commits:
    """The markers of one job."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def newest(self) -> int:
        """The last committed batch, -1 before the first."""
        folder = self._path(f"{self.root}/_done")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder)), default=-1) if self._fs.exists(folder) else -1

    def committed(self, batch: int) -> bool:
        return batch <= self.newest()

    def commit(self, batch: int) -> None:
        self._fs.create(self._path(f"{self.root}/_done/{batch}"), True).close()
        old = batch - KEEP
        for path in [f"_done/{old}", *[f"{t}/lo={lo}/size={n}" for t in self.tables for lo, n in set(live(old)) - set(live(old + 1))]]:
            if old >= 0:
                self._fs.delete(self._path(f"{self.root}/{path}"), True)


class KeyedRuns:
    """One row for each ``key``; ``base`` has the rows of keys that were never written (the account dimension, say)."""

    def __init__(self, commits: Commits, name: str, key: str, schema: T.StructType, base: DataFrame | None = None):
        commits.tables.append(name)
        self.commits, self.root, self.key, self.schema, self.base = commits, f"{commits.root}/{name}", key, schema, base

    def _latest(self, runs: list[tuple[int, int]], keys: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
        spark, names = self.commits.spark, self.schema.fieldNames()
        stored = T.StructType([*self.schema.fields, T.StructField("lo", T.LongType())])
        parts = [] if base is None else [base.select(*names, F.lit(-1).cast("long").alias("lo"))]
        if runs:
            parts.append(spark.read.schema(stored).option("basePath", self.root).parquet(*[f"{self.root}/lo={lo}/size={n}" for lo, n in runs]).drop("size"))
        rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], stored)
        if keys is not None:
            rows = rows.join(keys.distinct(), self.key, "left_semi")
        if len(runs) + (base is not None) > 1:
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "lo").alias("row")).select("row.*")
        return rows.select(*names)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """Committed rows, only those of ``keys`` (one column, named as the key) if given."""
        return self._latest(live(self.commits.newest() + 1), keys, self.base)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write the rows of an uncommitted batch (one for each key), and the fold of the runs that it completes."""
        overwrite(rows.select(*self.schema.fieldNames()), f"{self.root}/lo={batch}/size=1")
        lo, size = live(batch + 1)[-1]
        if size > 1:
            overwrite(self._latest([r for r in live(batch) if r[0] >= lo] + [(batch, 1)]), f"{self.root}/lo={lo}/size={size}")
