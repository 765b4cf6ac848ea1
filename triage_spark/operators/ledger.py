"""Ticket ledger: rows, stored-outcome lookup, new-ticket branch and upsert.

SCL-17/18/23, SRC-5, SRC-8, JOIN-1, FLT-5, FLT-6, SNK-1, WIN-5, CON-6, Q9/Q10.

The ledger holds one row per idempotency key.  ``actions_taken`` is JSON
text (the service stores JSONB).  ``ticket_key`` stands in for the row UUID:
``sha2(idempotency_key, 256)``, deterministic so re-runs and audit rows agree
without a join (JOIN-4).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .model_feed import normalized
from .skew import DEFAULT_HOT_ROWS, skew_join

LEDGER_COLUMNS = [
    "ticket_key",
    "idempotency_key",
    "ticket_id",
    "customer_id",
    "customer_email",
    "subject",
    "body",
    "category",
    "priority",
    "status",
    "confidence_score",
    "resolution_summary",
    "customer_reply",
    "actions_taken",
    "execution_time_ms",
    "cost_estimate_usd",
    "created_at",
    "updated_at",
]
# Columns of a resolved frame that ``ledger_rows`` reads.
RESOLVED_FOR_LEDGER = [
    "key",
    "event_id",
    "ticket_id",
    "customer_id",
    "customer_email",
    "subject",
    "body",
    "category",
    "status",
    "confidence_score",
    "reasoning",
    "customer_reply",
    "actions_taken",
    "execution_time_ms",
    "created_at",
]
# Columns an upsert overwrites (the rest keep their first value, Q9/Q10).
MUTABLE = [
    "status",
    "confidence_score",
    "resolution_summary",
    "customer_reply",
    "actions_taken",
    "execution_time_ms",
    "updated_at",
]


def ticket_key(key: str | Column = "idempotency_key") -> Column:
    return F.sha2(F.col(key) if isinstance(key, str) else key, 256)


def json_str(c: Column) -> Column:
    """A JSON string literal for ``c`` (``null`` when c is null)."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def actions_json() -> Column:
    """All of ``actions_taken`` of a resolved row as JSON text, in order (raw result JSON embedded)."""

    def item(one: Column) -> Column:
        return F.concat(
            F.lit('{"tool_name":'),
            json_str(one["tool_name"]),
            F.lit(',"parameters":'),
            F.coalesce(F.to_json(one["parameters"]), F.lit("{}")),
            F.lit(',"result":'),
            F.coalesce(one["result"], F.lit("{}")),
            F.lit(',"success":'),
            F.when(one["success"], F.lit("true")).otherwise(F.lit("false")),
            F.lit(',"error":'),
            json_str(one["error"]),
            F.lit("}"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform("actions_taken", item), ","), F.lit("]"))


def ledger_rows(resolved: DataFrame, status: Column | None = None, actions: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Project resolved tickets to the ledger schema (CON-6 defaults for omitted columns).

    ``actions``: the actions as JSON text where they were written out before; ``keep``: further columns.
    """
    return resolved.select(
        ticket_key("key").alias("ticket_key"),
        F.col("key").alias("idempotency_key"),
        "ticket_id",
        "customer_id",
        "customer_email",
        "subject",
        "body",
        "category",
        F.lit(C.DEFAULT_PRIORITY).alias("priority"),
        (status if status is not None else F.col("status")).alias("status"),
        F.col("confidence_score").cast("decimal(4,3)").alias("confidence_score"),
        F.col("reasoning").alias("resolution_summary"),
        "customer_reply",
        (actions if actions is not None else actions_json()).alias("actions_taken"),
        "execution_time_ms",
        F.lit(C.DEFAULT_COST_USD).cast("decimal(6,4)").alias("cost_estimate_usd"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        *keep,
    )


def readable(ledger: DataFrame) -> DataFrame:
    """FLT-5: only RESOLVED / ESCALATED rows count as stored outcomes."""
    return ledger.filter(F.col("status").isin(*C.STORED_OUTCOME_STATUSES))


def hits(incoming: DataFrame, ledger: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """JOIN-1 + FLT-6 (processed branch): incoming requests with a stored outcome.

    ``incoming`` carries ``key``; the stored columns come back prefixed
    ``stored_``.  Salted on hot keys: a repeated key may hold many requests.
    """
    stored = readable(ledger).select(
        F.col("idempotency_key").alias("key"),
        *[F.col(c).alias(f"stored_{c}") for c in ledger.columns if c != "idempotency_key"],
    )
    return skew_join(incoming, stored, ["key"], "inner", salt_by=["ticket_id", "created_at"], hot_rows=hot_rows)


def misses(incoming: DataFrame, ledger: DataFrame, hot_rows: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """FLT-6 (new branch): incoming requests without a readable stored outcome.

    ``hot_rows=None`` when ``incoming`` has one row per key: no key is hot, so rows stay where their key is.
    """
    keys = readable(ledger).select(F.col("idempotency_key").alias("key"))
    if hot_rows is None:
        return incoming.join(keys, "key", "left_anti")
    return skew_join(incoming, keys, ["key"], "left_anti", salt_by=["ticket_id", "created_at"], hot_rows=hot_rows)


def upsert(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """SNK-1 + WIN-5 + SCL-23: insert new keys, overwrite only the mutable columns of known keys.

    ``batch`` has one ledger-shaped row per key (dedupe first).  One full
    outer join on the key; each side has at most one row per key, so no key
    can skew it.  Adds ``change``: INSERTED, UPDATED or KEPT.
    """
    l_cols = [c for c in LEDGER_COLUMNS if c != "idempotency_key"]
    L = ledger.select("idempotency_key", *[F.col(c).alias(f"l_{c}") for c in l_cols], F.lit(True).alias("_in_l"))
    B = batch.select("idempotency_key", *[F.col(c).alias(f"b_{c}") for c in l_cols], F.lit(True).alias("_in_b"))
    j = L.join(B, "idempotency_key", "full_outer")
    in_l = F.coalesce(F.col("_in_l"), F.lit(False))
    in_b = F.coalesce(F.col("_in_b"), F.lit(False))
    out = []
    for c in LEDGER_COLUMNS:
        if c == "idempotency_key":
            out.append(F.col(c))
        elif c in MUTABLE:
            out.append(F.when(in_b, F.col(f"b_{c}")).otherwise(F.col(f"l_{c}")).alias(c))
        else:
            out.append(F.when(in_l, F.col(f"l_{c}")).otherwise(F.col(f"b_{c}")).alias(c))
    change = F.when(~in_l, F.lit("INSERTED")).when(in_b, F.lit("UPDATED")).otherwise(F.lit("KEPT"))
    return j.select(*out, change.alias("change"))


def cached_columns() -> list[Column]:
    """SCL-17: the stored outcome read back as a response (defaults when missing).

    Deviation Q7: only a *null* stored confidence reads back as 1.0; a stored
    0 stays 0, so a failed ticket never looks certain.
    """
    return [
        F.coalesce(F.col("stored_confidence_score"), F.lit(1).cast("decimal(4,3)")).alias("confidence_score"),
        F.coalesce(F.col("stored_category"), F.lit(C.DEFAULT_CATEGORY)).alias("category"),
        F.concat(F.lit(C.CACHED_REASONING_PREFIX), F.coalesce(F.col("stored_resolution_summary"), F.lit("None"))).alias(
            "reasoning"
        ),
        F.coalesce(F.col("stored_customer_reply"), F.lit("")).alias("customer_reply"),
        F.coalesce(F.col("stored_execution_time_ms"), F.lit(0)).alias("latency_ms"),
        cached_actions("stored_actions_taken").alias("actions_taken"),
    ]


def cached_actions(stored: str) -> Column:
    """SCL-16/17: the stored actions of a cached reply as JSON text, in the shape of a response; ``[]`` if none are stored.

    Each row's list is read and written within the row, so it travels with its reply.
    """

    def item(a: Column) -> Column:
        texts = {"tool_name": json_str(a["tool_name"]), "parameters": a["parameters_json"], "result": a["result_json"], "success": a["success"].cast("string"), "error": json_str(a["error"])}
        return F.concat(*[x for i, (k, v) in enumerate(texts.items()) for x in (F.lit(f'{"," if i else "{"}"{k}":'), v)], F.lit("}"))

    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(normalized(F.col(stored)), item), ","), F.lit("")), F.lit("]"))


#: CON-6: the ledger's columns with a default; it fills a column that an insert leaves out, never an explicit null.
DEFAULTS = {
    "category": ("STRING", f"'{C.DEFAULT_CATEGORY}'"),
    "priority": ("STRING", f"'{C.DEFAULT_PRIORITY}'"),
    "status": ("STRING", f"'{C.DEFAULT_STATUS}'"),
    "actions_taken": ("STRING", "'[]'"),
    "execution_time_ms": ("INT", "0"),
    "cost_estimate_usd": ("DECIMAL(6,4)", str(C.DEFAULT_COST_USD)),
}


def insert_rows(parts: list[DataFrame], path: str) -> DataFrame:
    """CON-6: insert frames, each with the columns that it has, into a Parquet table at ``path`` whose columns have defaults.

    The table is external, so its rows stay at ``path`` when its name is dropped from the session's catalog.
    """
    spark, name = parts[0].sparkSession, f"ledger_{uuid.uuid4().hex}"
    columns = ", ".join(["idempotency_key STRING", "ticket_id STRING", *(f"{c} {t} DEFAULT {d}" for c, (t, d) in DEFAULTS.items())])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{path}'")
    try:
        for part in parts:
            spark.sql(f"INSERT INTO {name} ({', '.join(part.columns)}) SELECT * FROM {{part}}", part=part)
        schema = spark.table(name).schema
    finally:
        spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(schema).parquet(path)
