"""Idempotency: one outcome per effective key (SCL-1, WIN-1, CON-4, SRT-2).

"First" is the smallest ``(created_at, ticket_id)``.  ``first_per_key`` is an
aggregate (``min`` of a struct led by the order columns), not a window: Spark plans it as a partial aggregate on
the map side and a final one after the shuffle, so a key holding a third of
all rows contributes one row per map task to the shuffle, never a whole group
to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import effective_key
from .skew import DEFAULT_HOT_ROWS, skew_join

ORDER = ("created_at", "ticket_id")


def with_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Add the effective key column (request key, else ticket_id).

    A request with neither breaks the contract; it has nothing in common with
    others of its kind, so a hash of the whole row is its key.
    """
    own = F.concat(F.lit("ROW-"), F.hex(F.xxhash64(*df.columns)))
    return df.withColumn(key, F.coalesce(effective_key(), own))


def row_hash(df: DataFrame, key: str = "key", order: Sequence[str] = ORDER) -> Column:
    """Tie-break for rows of one key with equal order columns: a hash of the rest of the row."""
    return F.xxhash64(*[F.col(c) for c in df.columns if c != key and c not in order])


def first_per_key(
    df: DataFrame, key: str = "key", order: Sequence[str] = ORDER, hash_ties: bool = True
) -> DataFrame:
    """WIN-1: the first row of every key, all columns kept.

    ``min`` over a struct whose leading fields are the order columns: structs
    compare field by field, so this is the row with the smallest order; ties
    on the order are broken by ``row_hash`` and then the remaining columns,
    so the pick is deterministic.  Measured faster than ``min_by`` with a
    separate ordering struct, and it combines map-side just the same.
    ``hash_ties=False`` when ``order`` already ends in such a hash.
    """
    payload = [c for c in df.columns if c != key]
    rest = [c for c in payload if c not in order]
    ties = [row_hash(df, key, order).alias("_tb")] if hash_ties else []
    picked = df.groupBy(key).agg(F.min(F.struct(*order, *ties, *rest)).alias("_first"))
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in payload])


def first_fields(
    df: DataFrame, fields: dict[str, Column], key: str = "key", order: Sequence[str] = ORDER
) -> DataFrame:
    """A narrow ``first_per_key``: only ``fields`` (per-row expressions) of each key's first row.

    Picks the same row as ``first_per_key(df)`` (same order, same
    ``row_hash`` tie-break over all of ``df``'s columns), but only the order
    columns, the hash and ``fields`` go through the shuffle.  Lets a second
    consumer of the first tickets skip the wide columns (texts).
    """
    picked = df.groupBy(key).agg(
        F.min(
            F.struct(*order, row_hash(df, key, order).alias("_tb"), *[v.alias(k) for k, v in fields.items()])
        ).alias("_first")
    )
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *fields)])


def replay(
    requests: DataFrame,
    outcomes: DataFrame,
    key: str = "key",
    keep: Sequence[str] = ("event_id", "ticket_id", "created_at"),
    hot_rows: int = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """WIN-1 replay: every request gets its key's first outcome.

    ``outcomes`` has one row per key (its columns are prefixed ``first_``
    where they clash); ``cached`` is true for every row but the first.
    The join is salted on hot keys (see ``skew_join``).
    """
    req = requests.select(key, *[F.col(c).alias(f"req_{c}") for c in keep])
    out = outcomes.select(key, *[F.col(c).alias(c if c == key else f"first_{c}") for c in outcomes.columns if c != key])
    joined = skew_join(req, out, [key], "inner", salt_by=[f"req_{c}" for c in keep], hot_rows=hot_rows)
    is_first = F.col("req_created_at").eqNullSafe(F.col("first_created_at")) & F.col("req_ticket_id").eqNullSafe(
        F.col("first_ticket_id")
    )
    return joined.withColumn("cached", ~is_first)


def duplicate_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """CON-4: keys that occur more than once, with their row count."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )
