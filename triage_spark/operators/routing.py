"""Routing by status and the message rows each route produces (FLT-7, SNK-3..7, SET-3, SCL-24/25).

Routing is a column (``route``); each sink is one filter over it, so all
routes come from one scan.  Messages are built with ``to_json(struct(...))``
in a fixed key order; values that are already JSON text are spliced in as
text so they stay objects, not strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import percent_text
from ..sources.feeds import iso_millis

RESOLUTION_COLOR = "#22c55e"
ALERT_COLOR = "#ef4444"


def with_route(df: DataFrame) -> DataFrame:
    """FLT-7: RESOLVED -> resolution card, ESCALATED -> escalation task, else UNROUTED."""
    return df.withColumn(
        "route",
        F.when(F.col("status") == "RESOLVED", F.lit("resolution_card"))
        .when(F.col("status") == "ESCALATED", F.lit("escalation_task"))
        .otherwise(F.lit("UNROUTED")),
    )


def route_counts(df: DataFrame) -> DataFrame:
    return with_route(df).groupBy("route").agg(F.count(F.lit(1)).alias("n_tickets"))


def _field(title: str, value: Column, short: bool) -> Column:
    return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))


def resolution_card(actions_text: Column) -> Column:
    """SNK-3: the resolution card as a struct (channel, text, one attachment of four fields)."""
    return F.struct(
        F.lit(C.RESOLUTION_CHANNEL).alias("channel"),
        F.format_string(C.RESOLUTION_TITLE, F.col("ticket_id")).alias("text"),
        F.array(
            F.struct(
                F.lit(RESOLUTION_COLOR).alias("color"),
                F.array(
                    _field("Category", F.col("category"), True),
                    _field("Confidence Score", percent_text("confidence_score"), True),
                    _field("Actions Executed", actions_text, False),
                    _field("Drafted Customer Reply", F.col("customer_reply"), False),
                ).alias("fields"),
            )
        ).alias("attachments"),
    )


def escalation_task() -> Column:
    """SNK-4 + SCL-25: name, markdown description, priority 1, tags with the lower-cased category."""
    return F.struct(
        F.format_string(C.ESCALATION_NAME, F.col("ticket_id"), F.col("category")).alias("name"),
        F.format_string(
            C.ESCALATION_DESCRIPTION, F.col("reasoning"), percent_text("confidence_score"), F.col("customer_reply")
        ).alias("description"),
        F.lit(1).alias("priority"),
        F.array(*[F.lit(t) for t in C.ESCALATION_TAGS], F.lower(F.col("category"))).alias("tags"),
    )


def ops_alert() -> Column:
    """SNK-5: the operations alert for one workflow failure (channel, text, one attachment of three fields)."""
    return F.struct(
        F.lit(C.ALERT_CHANNEL).alias("channel"),
        F.lit(C.ALERT_TEXT).alias("text"),
        F.array(
            F.struct(
                F.lit(ALERT_COLOR).alias("color"),
                F.format_string(C.ALERT_TITLE, F.col("workflow_name"), F.col("execution_id")).alias("title"),
                F.array(
                    _field("Error Message", F.col("error_message"), False),
                    _field("Failed At", iso_millis("failed_at"), True),
                    _field("Audit Status", F.lit(C.ALERT_AUDIT_STATUS), True),
                ).alias("fields"),
            )
        ).alias("attachments"),
    )


def repeat_reply() -> Column:
    """SNK-6: the short reply for a repeat request (stored ticket id and status)."""
    return F.to_json(
        F.struct(
            F.col("stored_ticket_id").alias("ticket_id"),
            F.col("stored_status").alias("status"),
            F.lit(True).alias("cached"),
            F.lit(C.CACHED_NOTE).alias("note"),
        )
    )


def response_json(actions_text: Column) -> Column:
    """SNK-7: the full response object; ``actions_taken`` is spliced in as JSON."""
    head = F.to_json(
        F.struct(
            "ticket_id",
            F.col("key").alias("idempotency_key"),
            "status",
            F.col("confidence_score").cast("double").alias("confidence_score"),
            "category",
            "reasoning",
        )
    )
    tail = F.to_json(
        F.struct(
            "customer_reply",
            F.col("execution_time_ms").alias("latency_ms"),
            F.lit(False).alias("cached"),
        )
    )
    return F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1),
        F.lit(',"actions_taken":'),
        actions_text,
        F.lit(","),
        F.substr(tail, F.lit(2)),
    )


def route_message(actions_text: Column) -> Column:
    """The message of a routed row as JSON: a resolution card or an escalation task (needs ``route``)."""
    card = F.when(F.col("route") == "resolution_card", F.to_json(resolution_card(actions_text)))
    return card.when(F.col("route") == "escalation_task", F.to_json(escalation_task()))
