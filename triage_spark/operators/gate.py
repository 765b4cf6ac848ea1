"""Confidence gate, decision texts and the exception fallback (SCL-8..10, FLT-3, UDF-2, STR-6)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rules import col, dec
from ..functions.text import fixed, gate_message, grouped


def threshold_col(threshold: Decimal | float | str = C.CONFIDENCE_THRESHOLD) -> Column:
    """UDF-2: the threshold is a parameter (default 0.80) compared as a decimal."""
    return F.lit(Decimal(str(threshold))).cast("decimal(4,3)")


def gate(df: DataFrame, threshold: Decimal | float | str = C.CONFIDENCE_THRESHOLD,
         confidence: str = "confidence_score") -> DataFrame:
    """FLT-3 + SCL-8: status, gate status and gate message from the confidence.

    Strict ``<``: a confidence equal to the threshold resolves.
    """
    thr = threshold_col(threshold)
    c = F.col(confidence)
    escalate = c < thr
    return df.withColumns(
        {
            "status": F.when(escalate, F.lit("ESCALATED")).otherwise(F.lit("RESOLVED")),
            "gate_status": F.when(escalate, F.lit("WARNING")).otherwise(F.lit("SUCCESS")),
            "gate_message": gate_message(c, thr),
        }
    )


def rule_reasoning(threshold: Decimal | float | str = C.CONFIDENCE_THRESHOLD) -> Column:
    """SCL-9: per-intent reasoning (before the gate message is appended).

    Needs columns category, target_tier, confirmation_id, balance_usd,
    overdue_invoices_count, confidence_score.
    """
    thr = threshold_col(threshold)
    return (
        F.when(
            F.col("category") == "SUBSCRIPTION",
            F.format_string(C.TPL_SUB_REASONING, F.col("target_tier"), F.col("confirmation_id")),
        )
        .when(
            F.col("category") == "BILLING",
            F.format_string(C.TPL_BILL_REASONING, fixed("balance_usd", 2), F.col("overdue_invoices_count")),
        )
        .otherwise(F.format_string(C.TPL_FALLBACK_REASONING, fixed("confidence_score", 2), fixed(thr, 2)))
    )


def rule_reply() -> Column:
    """SCL-10 / SCL-11: per-intent customer reply; the raw customer id is shown (Q19)."""
    return (
        F.when(
            F.col("category") == "SUBSCRIPTION",
            F.format_string(C.TPL_SUB_REPLY, F.col("customer_id"), F.col("target_tier")),
        )
        .when(
            F.col("category") == "BILLING",
            F.format_string(C.TPL_BILL_REPLY, grouped("balance_usd", 2), F.col("overdue_invoices_count")),
        )
        .otherwise(F.format_string(C.TPL_FALLBACK_REPLY, F.col("subject"), F.col("ticket_id")))
    )


def with_gated_reasoning(df: DataFrame, reasoning: str = "reasoning") -> DataFrame:
    """Append `` [gate message]`` to the reasoning (SCL-9)."""
    return df.withColumn(reasoning, F.concat(F.col(reasoning), F.lit(" ["), F.col("gate_message"), F.lit("]")))


def exception_outcome(error: str | Column) -> dict[str, Column]:
    """STR-6: the fallback projection for a ticket whose processing failed."""
    err = col(error)
    return {
        "status": F.lit("ESCALATED"),
        "category": F.lit("TECHNICAL"),
        "confidence_score": dec(Decimal("0.000")),
        "reasoning": F.format_string(C.TPL_EXC_REASONING, err),
        "customer_reply": F.format_string(C.TPL_EXC_REPLY, F.col("subject"), F.col("ticket_id")),
        "gate_status": F.lit("WARNING"),
    }
