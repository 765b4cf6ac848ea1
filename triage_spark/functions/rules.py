"""Column expressions for keys, matching text and the ordered intent rules.

All of these are built-in Catalyst expressions (no Python UDF), so they run
inside whole-stage codegen next to the scan.  The rule tables are data
(``constants``); the chain of ``when`` clauses is generated from them, which
keeps "first match wins" explicit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_key(key: str | Column = "idempotency_key", ticket_id: str | Column = "ticket_id") -> Column:
    """SCL-1: request key, or ticket_id when the key is null or empty."""
    return F.coalesce(F.nullif(col(key), F.lit("")), col(ticket_id))


def strip_ws(c: str | Column) -> Column:
    """Drop leading and trailing white space (plain ``trim`` only drops blanks)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\s+", ""), r"\s+$", "")


def normalize_id(c: str | Column) -> Column:
    """SCL-12 / SCL-13: strip white space, then upper case."""
    return F.upper(strip_ws(c))


def match_text(subject: str | Column = "subject", body: str | Column = "body") -> Column:
    """SCL-2: subject, a space, body, lower case (whole texts)."""
    return F.lower(F.concat_ws(" ", col(subject), col(body)))


def any_keyword(text: Column, words: list[str]) -> Column:
    """SCL-3: substring test for any of the words (not word-bounded)."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def intent(text: Column) -> Column:
    """SCL-4: SUBSCRIPTION, then BILLING, else the fallback subcategory."""
    return (
        F.when(any_keyword(text, C.SUBSCRIPTION_KEYWORDS), F.lit("SUBSCRIPTION"))
        .when(any_keyword(text, C.BILLING_KEYWORDS), F.lit("BILLING"))
        .otherwise(fallback_category(text))
    )


def fallback_category(text: Column) -> Column:
    """SCL-6: TECHNICAL when a technical word occurs, else GENERAL."""
    return F.when(any_keyword(text, C.TECHNICAL_KEYWORDS), F.lit("TECHNICAL")).otherwise(F.lit("GENERAL"))


def target_tier(text: Column) -> Column:
    """SCL-5: first tier word found, in rule order; default Enterprise."""
    chain = None
    for words, name in C.TIER_WORDS:
        cond = any_keyword(text, words)
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    return chain.otherwise(F.lit(C.DEFAULT_TARGET_TIER))


def dec(value, precision: int = 4, scale: int = 3) -> Column:
    return F.lit(value).cast(f"decimal({precision},{scale})")


def rule_confidence(category: Column, tool_ok: Column | None = None) -> Column:
    """SCL-7: 0.95 / 0.50 for a tier change (tool ok / failed), 0.93 billing, 0.55 otherwise."""
    ok = F.lit(True) if tool_ok is None else tool_ok
    return (
        F.when((category == "SUBSCRIPTION") & ok, dec(C.CONF_TIER_CHANGE_OK))
        .when(category == "SUBSCRIPTION", dec(C.CONF_TIER_CHANGE_FAILED))
        .when(category == "BILLING", dec(C.CONF_BILLING))
        .otherwise(dec(C.CONF_FALLBACK))
    )


def classify_columns(subject: str | Column = "subject", body: str | Column = "body") -> list[Column]:
    """category, target_tier (null unless SUBSCRIPTION) and rule confidence."""
    text = match_text(subject, body)
    category = intent(text)
    return [
        category.alias("category"),
        F.when(category == "SUBSCRIPTION", target_tier(text)).alias("target_tier"),
        rule_confidence(category).alias("confidence_score"),
    ]


def classify_text_columns(text: str | Column) -> list[Column]:
    """The same rules over one whole text (documents, conversation turns)."""
    t = F.lower(col(text))
    category = intent(t)
    return [
        category.alias("category"),
        F.when(category == "SUBSCRIPTION", target_tier(t)).alias("target_tier"),
        rule_confidence(category).alias("confidence_score"),
    ]
