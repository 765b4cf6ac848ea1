"""Point lookups in a stored table (SRC-8): rows sorted by key, with a bloom filter of the keys in each row group.

The table is cut into ranges of the key, each sorted, so the key statistics of a row group leave one group at most
for a key, and its bloom filter leaves none for most keys that are not stored.  A table that is joined by its key as well
is cut into buckets of the key in place of ranges: then neither its write (of rows that are by key) nor the joins shuffle it, and a lookup
leaves out the buckets without a wanted key.  A lookup reads the footers and the groups that remain; for more keys than ``MOST_KEYS`` a join is the right plan (``ledger.hits``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Keys of one lookup, which travel in its plan.
MOST_KEYS = 1_000
#: Bytes of a row group, and the distinct keys that its bloom filter is made for.
GROUP_BYTES, GROUP_KEYS = 8 << 20, 50_000


def write_sorted(df: DataFrame, path: str, key: str, files: int | None = None, group_bytes: int = GROUP_BYTES, group_keys: int = GROUP_KEYS, buckets: int | None = None) -> DataFrame:
    """``df`` as Parquet at ``path``, ready for ``lookup`` by ``key`` (null keys come first); returns the stored table.

    Ranges are cut from a sample of the keys, so a key that many rows hold makes one large file; the tables here hold a key once.
    """
    if buckets:
        writer = df.write.bucketBy(buckets, key).sortBy(key)
    else:
        ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
        writer = ranged.sortWithinPartitions(key).write
    writer = writer.option("parquet.block.size", str(group_bytes))
    for name, value in (("enabled", "true"), ("expected.ndv", str(group_keys))):
        writer = writer.option(f"parquet.bloom.filter.{name}#{key}", value)
    if buckets:
        return _bucketed(df.sparkSession, writer, path)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(spark: SparkSession, writer: DataFrameWriter, path: str) -> DataFrame:
    """Buckets need a table; it is external, so its files stay when its name is dropped from the session's catalog."""
    name = f"points_{uuid.uuid4().hex}"
    writer.format("parquet").option("path", path).saveAsTable(name)
    try:
        stored = spark.table(name)
        stored.schema  # resolved while the name is there
    finally:
        spark.sql(f"DROP TABLE {name}")
    return stored


def lookup(table: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """The rows of a stored table with one of the ``keys`` (nulls and repeats among them change nothing; none gives no row)."""
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) > MOST_KEYS:
        raise ValueError(f"{len(wanted)} keys; join the table with them instead")
    # A list of any length is pushed down whole: each row group's statistics and bloom filter are asked for every key.
    return table.filter(F.col(key).isin(wanted))
