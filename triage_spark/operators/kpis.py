"""Reports: KPI row, distributions, recent tickets, cost model (AGG-*, SRT-*, FLT-2, SCL-29/30).

Every report is one aggregation pass (partial aggregates on the map side);
only result rows leave the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import fixed


def kpi_summary(df: DataFrame) -> DataFrame:
    """AGG-1..6: total, resolved, escalated, rate, mean latency, time saved, savings."""
    resolved = F.count_if(F.col("status") == "RESOLVED")
    total = F.count(F.lit(1))
    avg_ms = F.coalesce(F.sum("execution_time_ms").cast("double") / F.count("execution_time_ms"), F.lit(0.0))
    manual = float(C.MANUAL_BENCHMARK_MINUTES)
    return df.agg(
        total.cast("bigint").alias("total_tickets"),
        resolved.cast("bigint").alias("resolved_tickets"),
        F.count_if(F.col("status") == "ESCALATED").cast("bigint").alias("escalated_tickets"),
        F.when(total > 0, F.round(resolved.cast("double") * 100 / total, 2))
        .otherwise(F.lit(0.0))
        .alias("auto_resolution_rate_pct"),
        F.round(avg_ms, 2).alias("avg_execution_latency_ms"),
        F.round((F.lit(manual) - avg_ms / 60000.0) * 100 / F.lit(manual), 2).alias("time_saved_pct"),
        (resolved * F.lit(C.NET_SAVING_PER_RESOLVED)).cast("decimal(18,2)").alias("cost_savings_usd"),
    )


def status_distribution(df: DataFrame) -> DataFrame:
    """AGG-7 + SRT-4: tickets per status (nulls dropped), share of total, largest first.

    The share needs the grand total; it is taken with a window over the
    aggregated rows, whose number is bounded by the status domain.
    """
    counts = df.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("n_tickets"))
    total = F.sum("n_tickets").over(Window.partitionBy())
    return counts.withColumn(
        "pct", F.round(F.col("n_tickets").cast("double") * 100 / total, 2)
    ).orderBy(F.desc("n_tickets"), "status")


def confidence_histogram(df: DataFrame, width_thousandths: int = 50) -> DataFrame:
    """AGG-8: tickets per (status, confidence bin); bins are whole thousandths div width."""
    bin_ = F.expr(f"cast(confidence_score * 1000 as int) div {int(width_thousandths)}")
    return (
        df.filter(F.col("confidence_score").isNotNull())
        .groupBy("status", bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_tickets"))
        .withColumn("bin_start", (F.col("bin") * width_thousandths / F.lit(1000)).cast("decimal(4,3)"))
    )


def recent(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """SRT-1: rows from newest to oldest; the first ``k`` if given (Spark plans TakeOrderedAndProject)."""
    newest = df.orderBy(F.desc("created_at"), F.asc("ticket_id"))
    return (newest.limit(k) if k else newest).select(*columns)


def latest_per(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """FLT-2 / SRT-3 in bulk: the most recent row per ``key`` (an aggregate, hot-key safe)."""
    payload = [c for c in columns if c != key]
    order = ["created_at", "updated_at"]
    rest = [c for c in payload if c not in order]
    picked = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in payload])


def cost_model(df: DataFrame, volumes: Sequence[int] = (5000,)) -> DataFrame:
    """AGG-9: monthly/yearly cost model at the observed auto-resolution share.

    For each monthly volume V: auto = floor(V * resolved / total),
    manual cost = V * 6.25, automated cost = auto * 0.03 + (V - auto) * 6.25.
    One aggregate pass; the volumes are exploded after it (no join).
    """
    stats = df.agg(
        F.count_if(F.col("status") == "RESOLVED").cast("bigint").alias("resolved"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )
    vol = F.explode(F.array(*[F.lit(int(v)).cast("bigint") for v in volumes])).alias("monthly_volume")
    s = stats.select("*", vol)
    auto = F.when(F.col("total") > 0, F.expr("(monthly_volume * resolved) div total")).otherwise(F.lit(0).cast("bigint"))
    s = s.withColumn("auto_resolved", auto).withColumn("escalated", F.col("monthly_volume") - F.col("auto_resolved"))
    manual_unit = F.lit(C.MANUAL_COST_PER_TICKET).cast("decimal(10,2)")
    ai_unit = F.lit(C.AI_COST_PER_TICKET).cast("decimal(10,2)")
    manual = (F.col("monthly_volume") * manual_unit).cast("decimal(18,2)")
    automated = (F.col("auto_resolved") * ai_unit + F.col("escalated") * manual_unit).cast("decimal(18,2)")
    return s.select(
        "monthly_volume",
        "auto_resolved",
        "escalated",
        manual.alias("manual_cost_usd"),
        automated.alias("automated_cost_usd"),
        (manual - automated).cast("decimal(18,2)").alias("monthly_saving_usd"),
        ((manual - automated) * 12).cast("decimal(18,2)").alias("yearly_saving_usd"),
    )


def display_rows(df: DataFrame) -> DataFrame:
    """SCL-30: dashboard table: two-decimal confidence, ``N ms`` latency."""
    return df.select(
        "ticket_id",
        "customer_id",
        "category",
        "priority",
        "status",
        fixed("confidence_score", 2).alias("confidence_text"),
        F.concat(F.col("execution_time_ms").cast("string"), F.lit(" ms")).alias("latency_text"),
        "subject",
    )


def minutes(ms_col: str) -> F.Column:
    """SCL-29: milliseconds to minutes."""
    return F.col(ms_col) / F.lit(60000.0)

