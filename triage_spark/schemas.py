"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, D = T.StringType, T.DecimalType

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("ticket_key", S()),
        T.StructField("idempotency_key", S()),
        T.StructField("ticket_id", S()),
        T.StructField("customer_id", S()),
        T.StructField("customer_email", S()),
        T.StructField("subject", S()),
        T.StructField("body", S()),
        T.StructField("category", S()),
        T.StructField("priority", S()),
        T.StructField("status", S()),
        T.StructField("confidence_score", D(4, 3)),
        T.StructField("resolution_summary", S()),
        T.StructField("customer_reply", S()),
        T.StructField("actions_taken", S()),
        T.StructField("execution_time_ms", T.IntegerType()),
        T.StructField("cost_estimate_usd", D(6, 4)),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("ticket_key", S()),
        T.StructField("idempotency_key", S()),
        T.StructField("step_name", S()),
        T.StructField("status", S()),
        T.StructField("confidence_score", D(4, 3)),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("input_payload", S()),
        T.StructField("output_payload", S()),
        T.StructField("error_message", S()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

ACCOUNT_STATE_SCHEMA = T.StructType(
    [
        T.StructField("account_id", S()),
        T.StructField("company_name", S()),
        T.StructField("current_tier", S()),
        T.StructField("balance_usd", D(18, 2)),
        T.StructField("currency", S()),
        T.StructField("overdue_invoices_count", T.IntegerType()),
        T.StructField("overdue_amount_usd", D(18, 2)),
        T.StructField("credit_limit_usd", D(18, 2)),
        T.StructField("billing_cycle", S()),
        T.StructField("seats_allocated", T.IntegerType()),
        T.StructField("status", S()),
        T.StructField("tier_changes", T.LongType()),
        T.StructField("tool_calls", T.LongType()),
        T.StructField("is_new", T.BooleanType()),
    ]
)

FIRSTS_SCHEMA = T.StructType(
    [
        T.StructField("key", S()),
        T.StructField("event_id", T.LongType()),
        T.StructField("ticket_id", S()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
