"""Audit log rows (SET-1, SET-2, SNK-2, SNK-8, CON-5, SCL-18/20/21/27).

Several step rows per ticket come from one pass: ``explode`` over an array of
step structs, never a union of separate scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .ledger import json_str, ticket_key

AUDIT_COLUMNS = [
    "ticket_key",
    "idempotency_key",
    "step_name",
    "status",
    "confidence_score",
    "latency_ms",
    "input_payload",
    "output_payload",
    "error_message",
    "created_at",
]


def _step(name, status, conf, latency, inp, out, err, ts) -> Column:
    return F.struct(
        F.lit(name).alias("step_name") if isinstance(name, str) else name.alias("step_name"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        conf.cast("decimal(4,3)").alias("confidence_score"),
        latency.cast("int").alias("latency_ms"),
        inp.alias("input_payload"),
        out.alias("output_payload"),
        err.cast("string").alias("error_message"),
        ts.alias("created_at"),
    )


def _json(**fields: Column) -> Column:
    """SCL-18: JSON object with fixed key order, nulls written as null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def entry_rows(entries: DataFrame) -> DataFrame:
    """SCL-20 + CON-10: arriving audit entries as stored: an empty or missing payload is null, a missing latency 0."""
    payload = F.when(F.size("input_payload") > 0, F.to_json("input_payload"))
    return entries.withColumns({"input_payload": payload, "latency_ms": F.coalesce("latency_ms", F.lit(0))})


def step_rows(decided: DataFrame) -> DataFrame:
    """SET-1: ingestion row + gate row for every processed ticket.

    Ingestion latency is 0 (it is the first step); the gate row carries the
    ticket's execution time.  Needs key, ticket_id, customer_id, subject,
    status, gate_status, gate_message, confidence_score, execution_time_ms,
    created_at.
    """
    ingest = _step(
        C.STEP_INGESTION,
        "SUCCESS",
        F.lit(1),
        F.lit(0),
        _json(ticket_id=F.col("ticket_id"), customer_id=F.col("customer_id"), subject=F.col("subject")),
        F.lit(None).cast("string"),
        F.lit(None),
        F.col("created_at"),
    )
    gate = _step(
        C.STEP_GATE,
        F.col("gate_status"),
        F.col("confidence_score"),
        F.coalesce(F.col("execution_time_ms"), F.lit(0)),
        F.lit(None).cast("string"),
        _json(status=F.col("status"), gate_decision=F.col("gate_message")),
        F.lit(None),
        F.col("created_at"),
    )
    return _explode(decided, F.array(ingest, gate))


def fallback_step_rows(failed: DataFrame) -> DataFrame:
    """STR-6 / Q24: ingestion row + fallback row for a ticket whose processing failed."""
    ingest = _step(
        C.STEP_INGESTION,
        "SUCCESS",
        F.lit(1),
        F.lit(0),
        _json(ticket_id=F.col("ticket_id"), customer_id=F.col("customer_id"), subject=F.col("subject")),
        F.lit(None).cast("string"),
        F.lit(None),
        F.col("created_at"),
    )
    fallback = _step(
        C.STEP_FALLBACK,
        "WARNING",
        F.lit(0),
        F.coalesce(F.col("execution_time_ms"), F.lit(0)),
        F.lit(None).cast("string"),
        _json(action=F.lit(C.EXC_ACTION)),
        F.col("error"),
        F.col("created_at"),
    )
    return _explode(failed, F.array(ingest, fallback))


def _explode(df: DataFrame, steps: Column) -> DataFrame:
    out = df.select(
        ticket_key("key").alias("ticket_key"), F.col("key").alias("idempotency_key"), F.explode(steps).alias("s")
    )
    return out.select("ticket_key", "idempotency_key", "s.*")


def backfill_rows(ledger: DataFrame) -> DataFrame:
    """SET-2 + SCL-21/27: two historical steps per ledger row.

    A 15 ms key-check step stamped 300 ms before the ticket, then the decision
    step (SUCCESS when RESOLVED, else WARNING) with the stored actions embedded.
    """
    check = _step(
        C.STEP_IDEMPOTENCY,
        "SUCCESS",
        F.lit(1),
        F.lit(15),
        _json(idempotency_key=F.col("idempotency_key")),
        F.lit('{"is_duplicate":false}'),
        F.lit(None),
        F.col("created_at") - F.expr("INTERVAL 300 MILLISECONDS"),
    )
    decision_out = F.concat(
        F.lit('{"status":'),
        json_str(F.col("status")),
        F.lit(',"confidence_score":'),
        F.coalesce(F.col("confidence_score").cast("double").cast("string"), F.lit("null")),
        F.lit(',"actions":'),
        F.coalesce(F.col("actions_taken"), F.lit("null")),
        F.lit("}"),
    )
    decision = _step(
        C.STEP_INTENT,
        F.when(F.col("status") == "RESOLVED", F.lit("SUCCESS")).otherwise(F.lit("WARNING")),
        F.col("confidence_score"),
        F.col("execution_time_ms"),
        _json(subject=F.col("subject"), body=F.col("body")),
        decision_out,
        F.lit(None),
        F.col("created_at"),
    )
    out = ledger.select("ticket_key", "idempotency_key", F.explode(F.array(check, decision)).alias("s"))
    return out.select("ticket_key", "idempotency_key", "s.*")


def relink(audit: DataFrame, ledger: DataFrame) -> DataFrame:
    """CON-5: keep every audit row; a link to a missing ticket becomes null.

    One left join on the key (at most one ledger row per key, at most a
    handful of audit rows per key).
    """
    parents = ledger.select("idempotency_key", F.col("ticket_key").alias("_parent"))
    j = audit.join(parents, "idempotency_key", "left")
    return j.withColumn("orphan", F.col("_parent").isNull()).withColumn(
        "ticket_key", F.when(F.col("_parent").isNotNull(), F.col("ticket_key"))
    ).drop("_parent")


def with_log_date(audit: DataFrame) -> DataFrame:
    """Partition column of the append-only audit table (SNK-2)."""
    return audit.withColumn("log_date", F.to_date("created_at"))
