"""Ledger plan over fixture F4: a stored ledger, then one incoming batch.

Tickets before the cut-off are the ledger (first per key; some stored as
PENDING or FAILED); tickets from the cut-off on are one incoming batch:

incoming -> key -> [hits: readable stored outcome]  -> cached replies
                -> [misses] -> first per key -> resolve (account state as
                   left by the ledger) -> ledger rows -> upsert
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import ledger as L
from ..operators.dedupe import first_per_key, with_key
from ..operators.skew import DEFAULT_HOT_ROWS
from ..session import scratch_path
from ..sinks.points import write_sorted
from ..sources.fixtures import LEDGER_CUTOFF
from . import triage as TR


@dataclass
class LedgerInputs:
    seed: DataFrame  # ledger rows before the cut-off
    incoming: DataFrame  # keyed requests from the cut-off on
    state: DataFrame  # accounts after the ledger's tool calls
    tiers: DataFrame
    stored: dict[str, DataFrame] = field(default_factory=dict)  # tables of later steps, written once


def as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: readers prune columns and rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_keyed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """``as_table`` laid out for joins and point lookups by ``key``, in a bucket for each shuffle partition."""
    spark = df.sparkSession
    return write_sorted(df, scratch_path(spark, name), key, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))


def points(li: LedgerInputs) -> DataFrame:
    """The stored ledger laid out for point lookups by idempotency key, as the historical load wrote it."""
    return li.seed


def cutoff():
    return F.lit(LEDGER_CUTOFF).cast("timestamp_ntz")


def seed_status():
    """some stored rows are PENDING or FAILED (they must be processed again)."""
    eid = F.col("event_id")
    return F.when(eid % 17 == 0, F.lit("PENDING")).when(eid % 19 == 0, F.lit("FAILED")).otherwise(F.col("status"))


_PREPARED: dict[tuple[str, str, int], LedgerInputs] = {}


def prepare(spark: SparkSession, sf_dir: str, hot_rows: int = DEFAULT_HOT_ROWS) -> LedgerInputs:
    """The stored ledger and account state as of the cut-off, built once per session.

    Like any stored table it is written once (the historical load) and then
    read by every query of the session.
    """
    memo = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), hot_rows)
    if memo not in _PREPARED:
        _PREPARED[memo] = _build(spark, sf_dir, hot_rows)
    return _PREPARED[memo]


def _build(spark: SparkSession, sf_dir: str, hot_rows: int) -> LedgerInputs:
    i = TR.load(spark, sf_dir)
    keyed = with_key(i.requests)
    pre = keyed.filter(F.col("created_at") < cutoff())
    inc = keyed.filter(F.col("created_at") >= cutoff())
    # The historical load (SRC-5) is a table in its own right: it is written
    # once (Parquet in the shared spark.checkpoint.dir) and read back, so
    # consumers scan the columns they need instead of recomputing its plan.
    # Next to the ledger's columns it holds those of the tool calls.
    pre_res = TR.resolve(pre, i.accounts, i.tiers, hot_rows=hot_rows)
    calls = [c for c in A.TOOL_CALL_COLUMNS if c not in L.LEDGER_COLUMNS]
    rows = L.ledger_rows(pre_res, seed_status(), keep=calls)
    load = as_keyed_table(rows, "ledger-load", "idempotency_key")
    state = as_table(A.account_state(i.accounts, A.tool_calls(load)).select("account_id", *A.ACCOUNT_FIELDS), "ledger-accounts")
    return LedgerInputs(seed=load.select(*L.LEDGER_COLUMNS), incoming=inc, state=state, tiers=i.tiers)


def new_tickets(li: LedgerInputs, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """FLT-6 new branch + WIN-1: first request per key without a stored outcome."""
    # A stored outcome belongs to a key, so the first requests are picked before: texts are shuffled once.
    return L.misses(first_per_key(li.incoming), li.seed, hot_rows=None)


def batch_rows(li: LedgerInputs, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    # The first tickets of the misses are found once; resolve reads them several times.
    if "new" not in li.stored:
        li.stored["new"] = as_keyed_table(TR.classify(new_tickets(li, hot_rows)), "ledger-new", "key")
    return L.ledger_rows(TR.resolve(li.stored["new"], li.state, li.tiers, hot_rows=hot_rows, deduped=True, classified=True))


def upserted(li: LedgerInputs, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    return L.upsert(li.seed, batch_rows(li, hot_rows))


def stored_ledger(li: LedgerInputs) -> DataFrame:
    """The ledger after the incoming batch as a stored table; reports read this."""
    if "ledger" not in li.stored:
        li.stored["ledger"] = as_table(upserted(li), "ledger")
    return li.stored["ledger"]
