"""Contracts: rule lists -> an array of violation codes per row (CON-1..10).

A rule is ``(code, predicate)``; the predicate is true when the row breaks
the rule.  All rules of a contract are evaluated in one projection:
``filter(array(when(p1, code1), when(p2, code2), ...), x -> x is not null)``.
``split`` gives the good rows and the quarantine from the same column, so
good + quarantine = input (no row is dropped).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as C
from ..sinks.runs import overwrite

Rule = tuple[str, Column]


def violations(rules: Sequence[Rule]) -> Column:
    arr = F.array(*[F.when(pred, F.lit(code)) for code, pred in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def check(df: DataFrame, rules: Sequence[Rule], name: str = "violations") -> DataFrame:
    """Add ``violations`` (array), ``violation_text`` (comma list) and ``n_violations``."""
    v = violations(rules)
    return df.withColumns(
        {
            name: v,
            "violation_text": F.array_join(v, ","),
            "n_violations": F.size(v),
        }
    )


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantine rows of a checked frame."""
    return checked.filter(F.col("n_violations") == 0), checked.filter(F.col("n_violations") > 0)


def store_checked(checked: DataFrame, rules: Sequence[Rule], path: str) -> dict[str, int]:
    """Write a checked frame, good and quarantined rows in folders of their own, and count in the same pass.

    The counts (``rows``, ``broken`` and one for each rule) are observed while the rows are written, so
    neither the input is read again nor a row is held; they are a few numbers whatever the input.
    """
    seen = Observation()
    each = [F.count_if(F.array_contains("violations", code)).alias(code) for code, _ in rules]
    marked = checked.withColumn("broken", F.col("n_violations") > 0)
    watched = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("broken").alias("broken"), *each)
    overwrite(watched, path, "broken")
    got = seen.get
    return {name: got.get(name) or 0 for name in ("rows", "broken", *(code for code, _ in rules))}


def _missing(c: str) -> Column:
    return F.col(c).isNull()


def _blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(c) < 1)


def request_rules() -> list[Rule]:
    """CON-1: ticket_id, customer_id, subject, body required; subject and body non-empty."""
    return [
        ("TICKET_ID_REQUIRED", _missing("ticket_id")),
        ("CUSTOMER_ID_REQUIRED", _missing("customer_id")),
        ("SUBJECT_REQUIRED", _missing("subject")),
        ("SUBJECT_EMPTY", _blank("subject")),
        ("BODY_REQUIRED", _missing("body")),
        ("BODY_EMPTY", _blank("body")),
    ]


def ledger_rules(confidence_raw: str = "confidence_raw") -> list[Rule]:
    """CON-2 + CON-7: domains, not-null columns, VARCHAR lengths, NUMERIC(4,3) fit."""
    rules: list[Rule] = [
        ("KEY_REQUIRED", _missing("idempotency_key")),
        ("TICKET_ID_REQUIRED", _missing("ticket_id")),
        ("CUSTOMER_ID_REQUIRED", _missing("customer_id")),
        ("SUBJECT_REQUIRED", _missing("subject")),
        ("BODY_REQUIRED", _missing("body")),
        ("STATUS_REQUIRED", _missing("status")),
        ("PRIORITY_DOMAIN", F.col("priority").isNotNull() & ~F.col("priority").isin(*C.TICKET_PRIORITIES)),
        ("STATUS_DOMAIN", F.col("status").isNotNull() & ~F.col("status").isin(*C.LEDGER_STATUSES)),
    ]
    for c, n in C.LEDGER_LENGTHS.items():
        rules.append((f"{c.upper()}_TOO_LONG", F.length(c) > n))
    raw = F.col(confidence_raw)
    rules.append(("CONFIDENCE_OVERFLOW", raw.isNotNull() & raw.try_cast("decimal(4,3)").isNull()))
    return rules


def audit_rules() -> list[Rule]:
    """CON-3 + CON-10: step and status required, status domain, latency not negative."""
    return [
        ("STEP_REQUIRED", _missing("step_name")),
        ("STATUS_REQUIRED", _missing("status")),
        ("STATUS_DOMAIN", F.col("status").isNotNull() & ~F.col("status").isin(*C.AUDIT_STATUSES)),
        ("STEP_TOO_LONG", F.length("step_name") > 64),
        ("LATENCY_NEGATIVE", F.col("latency_ms") < 0),
        ("CONFIDENCE_RANGE", (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1)),
    ]


def response_rules() -> list[Rule]:
    """CON-9: confidence 0..1, status domain, each action names its tool and success."""
    acts = F.col("actions_taken")
    return [
        ("CONFIDENCE_RANGE", (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1)),
        ("STATUS_DOMAIN", ~F.coalesce(F.col("status").isin(*C.RESPONSE_STATUSES), F.lit(False))),
        (
            "ACTION_INCOMPLETE",
            ~F.coalesce(F.forall(acts, lambda a: a["tool_name"].isNotNull() & a["success"].isNotNull()), F.lit(True)),
        ),
    ]
