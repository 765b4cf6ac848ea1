"""Hot-key handling for equi joins.

A single key (one idempotency key, one account) may hold a third of all rows.
A plain shuffle join sends all of them to one task.  ``skew_join`` finds the
hot keys with a frequent-items sketch (one small sketch a task is shuffled, not a count
for every key), then salts only those keys:

* big side: hot rows get ``salt = pmod(xxhash64(salt_by), n_salts)``, cold rows 0;
* small side: hot rows are replicated ``n_salts`` times, cold rows once.

The join runs on ``keys + [salt]`` so a hot key is spread over ``n_salts``
tasks.  The hot-key list is broadcast; it has ``MOST_HOT`` keys at most, whatever the data.
The list only shapes the plan: results do not depend on it, and keys beyond it are left to AQE's skew join.  The salt is a
hash of row content, never ``rand()``, so a recomputed task after an executor
loss gets the same salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT_ROWS = 2_000_000
DEFAULT_SALTS = 64


#: Items that a sketch tracks (a key with more than about 1/2000 of all rows is never missed) and keys that a list holds.
TRACKED, MOST_HOT = 8192, 1000
#: Tasks that merge the sketches of the scan's tasks before the last one does.
MERGERS = 64


def heavy_hitters(df: DataFrame, key: str, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """key, n (about): the keys of at least ``hot_rows`` rows, by a frequent-items sketch.

    Each scan task sends one sketch of bounded size; they are merged in two steps, so the
    last task gets ``MERGERS`` sketches, however many tasks there are.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_g")
    # One null key more, as there is nothing to merge for a table without rows.
    none = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[key].dataType).alias("_k"), F.lit(0).alias("_g"))
    sketches = df.select(F.col(key).alias("_k"), group).unionAll(none).groupBy("_g").agg(F.expr(f"approx_top_k_accumulate(_k, {TRACKED})").alias("_s"))
    # Grouped by a constant: without a key, each empty partition would send a sketch of its own, which Spark cannot write.
    top = sketches.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {TRACKED}), {MOST_HOT})").alias("_t"))
    found = top.select(F.inline("_t").alias(key, "n"))
    return found.filter((F.col("n") >= hot_rows) & F.col(key).isNotNull())


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Keys holding at least ``hot_rows`` rows; several key columns are looked for as one text each."""
    keys = list(keys)
    if len(keys) == 1:
        return heavy_hitters(df, keys[0], hot_rows).select(*keys)
    one = F.to_json(F.struct(*keys)).alias("_key")
    schema = df.select(*keys).schema
    found = heavy_hitters(df.select(one), "_key", hot_rows)
    return found.select(F.from_json("_key", schema).alias("_v")).select(*[F.col("_v")[k].alias(k) for k in keys])


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] | None = None,
    hot_rows: int = DEFAULT_HOT_ROWS,
    n_salts: int = DEFAULT_SALTS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi join ``big`` (many rows per key) with ``small`` (few rows per key).

    ``how`` is one of inner, left, left_semi, left_anti (the big side is kept
    on the left).  ``salt_by`` names big-side columns that vary inside a key
    (for example the ticket id); they spread a hot key over ``n_salts`` tasks.
    ``hot`` optionally supplies the hot keys, one row per key (any superset of
    the true hot keys of ``big``, e.g. counted on the raw input before a
    dedupe, so ``big`` is not recomputed just to count it).
    """
    keys = list(keys)
    salt_cols = list(salt_by or [c for c in big.columns if c not in keys])
    # ``hot`` may be given precomputed (e.g. from a cheaper upstream scan whose
    # keys are a superset); salting a key that is not hot is harmless.
    hot_df = hot if hot is not None else hot_keys(big, keys, hot_rows)
    # a ``_hot`` column in ``hot`` is used as the marker (it lets a caller
    # share one hot-key aggregate between several consumers); else every row is hot
    flag = F.col("_hot") if "_hot" in hot_df.columns else F.lit(True)
    hot = F.broadcast(hot_df.select(*keys, flag.alias("_hot")))
    big_s = (
        big.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(n_salts))).otherwise(
                F.lit(0).cast("long")
            ),
        )
        .drop("_hot")
    )
    small_s = (
        small.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(n_salts - 1).cast("long"))).otherwise(
                    F.array(F.lit(0).cast("long"))
                )
            ),
        )
        .drop("_hot")
    )
    return big_s.join(small_s, keys + ["_salt"], how).drop("_salt")
