"""STR-4 with the state store as the account table: ``transformWithState`` over a stream of tool calls.

The state of an account starts from its row in the account table (initial state of the first batch) and moves with the
calls of each batch; only accounts with calls come out of a batch.  Before the shuffle each task folds its
calls to one row for each account and Arrow batch, so an account that holds a third of all calls sends few rows, and
the fold itself keeps one row.  As in the ledger stream, batches apply in the order they arrive, calls inside a batch by (created_at, ticket_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from .. import schemas as S

CALLS = T.StructType([T.StructField("account_id", T.StringType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("ticket_id", T.StringType()),
                      T.StructField("is_change", T.BooleanType()), T.StructField("tier_name", T.StringType()), T.StructField("max_seats", T.IntegerType())])
PARTIAL = "account_id string, last_at timestamp_ntz, last_ticket string, last_tier string, half int, changes long, calls long"
STATE = "current_tier string, seats_allocated int, tier_changes long, tool_calls long, is_new boolean"
OUT = f"account_id string, {STATE}"


def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each account of a batch: its last change, half of the most seats, numbers of changes and calls."""
    names = [part.split()[0] for part in PARTIAL.split(", ")]
    for calls in batches:
        change = calls["is_change"].fillna(False).astype(bool)
        by = calls["account_id"]
        counts = pd.DataFrame({"calls": 1, "changes": change.astype("int64"), "account_id": by}).groupby("account_id", dropna=False).sum()
        # Nulls come first in the order of Spark, so the last row of a sort with them in front is the greatest.
        moved = calls[change].sort_values(["created_at", "ticket_id", "tier_name"], na_position="first").groupby("account_id", dropna=False)
        last = moved.tail(1).set_index("account_id")[["created_at", "ticket_id", "tier_name"]]
        last.columns = ["last_at", "last_ticket", "last_tier"]
        half = moved["max_seats"].max() // 2
        folded = counts.join(last).join(half.rename("half").astype("Int32")).reset_index()[names]
        # Plain objects with None: columns that are null in part may be chunked, which Spark does not take.
        yield folded.astype({n: object for n in names}).where(folded.notna(), None)


class AccountFold(StatefulProcessor):
    """State: tier, seats, numbers of changes and calls, and whether the account was first seen by a call."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", STATE)

    def handleInitialState(self, key, row, timer_values) -> None:  # noqa: N802
        self.state.update((row.current_tier, row.seats_allocated, row.tier_changes, row.tool_calls, row.is_new))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:  # noqa: N802
        new = (C.DEFAULT_ACCOUNT["current_tier"], C.DEFAULT_ACCOUNT["seats_allocated"], 0, 0, True)
        tier, seats, changes, calls, is_new = self.state.get() if self.state.exists() else new
        last = None
        for r in rows:
            calls, changes = calls + r.calls, changes + r.changes
            if r.changes:
                at = (r.last_at is not None, r.last_at, r.last_ticket is not None, r.last_ticket, r.last_tier)
                last = at if last is None else max(last, at, key=_order)
                seats = max((x for x in (seats, r.half) if x is not None), default=None)
        if last is not None and last[-1] is not None:
            tier = last[-1]
        self.state.update((tier, seats, changes, calls, is_new))
        yield Row(account_id=key[0], current_tier=tier, seats_allocated=seats, tier_changes=changes, tool_calls=calls, is_new=is_new)

    def close(self) -> None:
        pass


def _order(at: tuple) -> tuple:
    has_time, time, has_ticket, ticket, tier = at
    return (has_time, time if has_time else 0, has_ticket, ticket or "", tier or "")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which ``transformWithState`` asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def moved_accounts(calls: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts that the calls of a batch reach, as they are after it; ``calls`` is a stream, ``accounts`` a table with the state columns."""
    start = accounts.select("account_id", *[c.split()[0] for c in STATE.split(", ")]).groupBy("account_id")
    folded = calls.select(*CALLS.fieldNames()).mapInPandas(partial, PARTIAL)
    return folded.groupBy("account_id").transformWithState(AccountFold(), OUT, "Update", "None", start)


def with_fields(moved: DataFrame, accounts: DataFrame, defaults) -> DataFrame:
    """The moved accounts as rows of the account table: fields that no call changes come from it, or are the defaults."""
    still = [f for f in S.ACCOUNT_STATE_SCHEMA.fieldNames() if f not in OUT and f != "account_id"]
    known = accounts.select(F.col("account_id").alias("own_id"), F.lit(True).alias("known"), *[F.col(c).alias(f"own_{c}") for c in still])
    j = moved.join(known, F.col("account_id") == F.col("own_id"), "left")
    cols = {c: F.when(F.col("known"), F.col(f"own_{c}")).otherwise(defaults[c]) for c in still}
    return j.select(*[(cols[c].alias(c) if c in cols else F.col(c)) for c in S.ACCOUNT_STATE_SCHEMA.fieldNames()])
