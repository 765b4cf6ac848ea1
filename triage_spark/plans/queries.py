"""Registry of named queries: Spark implementation + DuckDB oracle SQL.

Every Spark query reads the driver tables (via the fixture projections) and
runs over whole tables; result columns carry the same names as the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import accounts as A
from ..operators import kpis as K
from ..operators.dedupe import duplicate_keys, first_fields, first_per_key, replay, with_key
from ..functions.rules import effective_key
from ..sources import fixtures as FX
from . import oracle as O
from . import triage as TR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


_PLANS: dict[tuple, object] = {}


def shared(spark: SparkSession, *key, build: Callable[[], object]):
    """A logical plan several queries start from, built once per session.

    Only the lazy DataFrame is kept (no data is cached): every query still
    runs its whole plan over the whole tables.  Building a plan costs
    thousands of driver round trips, so reports that derive from the same
    pipeline (as a user would) reuse it instead of rebuilding it.
    """
    memo = (spark.sparkContext.applicationId, *key)
    if memo not in _PLANS:
        _PLANS[memo] = build()
    return _PLANS[memo]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, "requests", sf_dir, build=lambda: FX.ticket_requests(FX.table(spark, sf_dir, "events")))


def decided(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """TR.decide over the request feed (first per key, classified, gated)."""
    return shared(spark, "decided", sf_dir, keep, build=lambda: TR.decide(requests(spark, sf_dir), keep=list(keep)))


# ---------------------------------------------------------------- slice 1


@register(
    "effective_key",
    O.with_base("SELECT event_id, ticket_id, idempotency_key, key FROM keyed"),
)
def q_effective_key(spark, sf_dir):
    return with_key(requests(spark, sf_dir)).select("event_id", "ticket_id", "idempotency_key", "key")


@register(
    "classify",
    O.with_base(
        f"""SELECT event_id, ticket_id, {O.category_sql('mt')} AS category,
       CASE WHEN {O.category_sql('mt')} = 'SUBSCRIPTION' THEN {O.tier_sql('mt')} END AS target_tier,
       {O.confidence_sql(O.category_sql('mt'))} AS confidence_score
FROM (SELECT *, lower(subject || ' ' || body) AS mt FROM f1)"""
    ),
)
def q_classify(spark, sf_dir):
    return TR.classify(requests(spark, sf_dir)).select(
        "event_id", "ticket_id", "category", "target_tier", "confidence_score"
    )


@register(
    "gate",
    O.with_base(
        "SELECT key, ticket_id, category, confidence_score, status, gate_status, gate_message FROM gated"
    ),
)
def q_gate(spark, sf_dir):
    return decided(spark, sf_dir).select(
        "key", "ticket_id", "category", "confidence_score", "status", "gate_status", "gate_message"
    )


KPI_SQL = f"""SELECT CAST(count(*) AS BIGINT) AS total_tickets,
       CAST(count(*) FILTER (WHERE status = 'RESOLVED') AS BIGINT) AS resolved_tickets,
       CAST(count(*) FILTER (WHERE status = 'ESCALATED') AS BIGINT) AS escalated_tickets,
       CASE WHEN count(*) > 0 THEN round(CAST(count(*) FILTER (WHERE status = 'RESOLVED') AS DOUBLE) * 100 / count(*), 2) ELSE 0.0 END AS auto_resolution_rate_pct,
       round(coalesce(CAST(sum(execution_time_ms) AS DOUBLE) / count(execution_time_ms), 0.0), 2) AS avg_execution_latency_ms,
       round(({C.MANUAL_BENCHMARK_MINUTES} - coalesce(CAST(sum(execution_time_ms) AS DOUBLE) / count(execution_time_ms), 0.0) / 60000.0) * 100 / {C.MANUAL_BENCHMARK_MINUTES}, 2) AS time_saved_pct,
       CAST(count(*) FILTER (WHERE status = 'RESOLVED') * {C.NET_SAVING_PER_RESOLVED} AS DECIMAL(18,2)) AS cost_savings_usd
FROM {{src}}"""


@register("kpi_summary", O.with_base(KPI_SQL.format(src="gated")))
def q_kpi_summary(spark, sf_dir):
    return K.kpi_summary(decided(spark, sf_dir, ("execution_time_ms",)))


# ---------------------------------------------------------------- slice 2


@register("dedupe_first", O.with_base("SELECT key, event_id, ticket_id, created_at FROM firsts"))
def q_dedupe_first(spark, sf_dir):
    firsts = first_fields(with_key(requests(spark, sf_dir)), {"event_id": F.col("event_id")})
    return firsts.select("key", "event_id", "ticket_id", "created_at")


@register(
    "dedupe_replay",
    O.with_base(
        """SELECT k.event_id, k.ticket_id, k.key, g.ticket_id AS first_ticket_id, g.status, g.category,
       (k.ticket_id <> g.ticket_id OR k.created_at <> g.created_at) AS cached
FROM keyed k JOIN gated g ON g.key = k.key"""
    ),
)
def q_dedupe_replay(spark, sf_dir):
    req = with_key(requests(spark, sf_dir))
    out = decided(spark, sf_dir).select("key", "ticket_id", "created_at", "status", "category")
    r = replay(req, out)
    return r.select(
        F.col("req_event_id").alias("event_id"),
        F.col("req_ticket_id").alias("ticket_id"),
        "key",
        "first_ticket_id",
        F.col("first_status").alias("status"),
        F.col("first_category").alias("category"),
        "cached",
    )


@register(
    "duplicate_keys",
    O.with_base("SELECT key, CAST(count(*) AS BIGINT) AS n_rows FROM keyed GROUP BY key HAVING count(*) > 1"),
)
def q_duplicate_keys(spark, sf_dir):
    return duplicate_keys(with_key(requests(spark, sf_dir)))


@register(
    "status_distribution",
    O.with_base(
        """SELECT status, CAST(count(*) AS BIGINT) AS n_tickets,
       round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 2) AS pct
FROM gated WHERE status IS NOT NULL GROUP BY status"""
    ),
)
def q_status_distribution(spark, sf_dir):
    return K.status_distribution(decided(spark, sf_dir))


@register(
    "confidence_histogram",
    O.with_base(
        """SELECT status, CAST(CAST(confidence_score * 1000 AS INTEGER) // 50 AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS n_tickets,
       CAST((CAST(confidence_score * 1000 AS INTEGER) // 50) * 50 / 1000 AS DECIMAL(4,3)) AS bin_start
FROM gated WHERE confidence_score IS NOT NULL GROUP BY ALL"""
    ),
)
def q_confidence_histogram(spark, sf_dir):
    return K.confidence_histogram(decided(spark, sf_dir))


RECENT_COLS = ["ticket_id", "customer_id", "category", "status", "confidence_score", "created_at"]


@register(
    "recent_tickets",
    O.with_base(
        "SELECT ticket_id, customer_id, category, status, confidence_score, created_at FROM gated "
        "ORDER BY created_at DESC, ticket_id"
    ),
)
def q_recent_tickets(spark, sf_dir):
    return K.recent(decided(spark, sf_dir, ("customer_id",)), RECENT_COLS)


@register(
    "cost_model",
    O.with_base(
        f"""SELECT monthly_volume, auto_resolved, monthly_volume - auto_resolved AS escalated,
       CAST(monthly_volume * {C.MANUAL_COST_PER_TICKET} AS DECIMAL(18,2)) AS manual_cost_usd,
       CAST(auto_resolved * {C.AI_COST_PER_TICKET} + (monthly_volume - auto_resolved) * {C.MANUAL_COST_PER_TICKET} AS DECIMAL(18,2)) AS automated_cost_usd,
       CAST(monthly_volume * {C.MANUAL_COST_PER_TICKET} - (auto_resolved * {C.AI_COST_PER_TICKET} + (monthly_volume - auto_resolved) * {C.MANUAL_COST_PER_TICKET}) AS DECIMAL(18,2)) AS monthly_saving_usd,
       CAST(12 * (monthly_volume * {C.MANUAL_COST_PER_TICKET} - (auto_resolved * {C.AI_COST_PER_TICKET} + (monthly_volume - auto_resolved) * {C.MANUAL_COST_PER_TICKET})) AS DECIMAL(18,2)) AS yearly_saving_usd
FROM (SELECT CAST(5000 AS BIGINT) AS monthly_volume,
             CAST(CASE WHEN count(*) > 0 THEN (5000 * count(*) FILTER (WHERE status = 'RESOLVED')) // count(*) ELSE 0 END AS BIGINT) AS auto_resolved
      FROM gated)"""
    ),
)
def q_cost_model(spark, sf_dir):
    return K.cost_model(decided(spark, sf_dir), (5000,))


# ---------------------------------------------------------------- slice 3


def inputs(spark, sf_dir) -> TR.Inputs:
    return shared(spark, "inputs", sf_dir, build=lambda: TR.load(spark, sf_dir))


@register(
    "account_lookup",
    O.with_base(
        """SELECT event_id, ticket_id, account_id, account_found, acct_company_name AS company_name,
       acct_current_tier AS current_tier, acct_balance_usd AS balance_usd,
       acct_overdue_invoices_count AS overdue_invoices_count, acct_seats_allocated AS seats_allocated,
       acct_status AS account_status
FROM (""" + O.lookup_sql("f1") + ")"
    ),
)
def q_account_lookup(spark, sf_dir):
    i = inputs(spark, sf_dir)
    df = A.lookup_accounts(i.requests, i.accounts)
    return df.select(
        "event_id",
        "ticket_id",
        "account_id",
        "account_found",
        F.col("acct_company_name").alias("company_name"),
        F.col("acct_current_tier").alias("current_tier"),
        F.col("acct_balance_usd").alias("balance_usd"),
        F.col("acct_overdue_invoices_count").alias("overdue_invoices_count"),
        F.col("acct_seats_allocated").alias("seats_allocated"),
        F.col("acct_status").alias("account_status"),
    )


@register(
    "tier_pricing_join",
    O.with_base(
        f"""SELECT f.event_id, f.requested_tier, {O.norm_sql('f.requested_tier')} AS tier_key, t.name AS tier_name,
       t.monthly_cost, t.max_seats, t.sla_hours, t.tier_key IS NOT NULL AS tier_valid,
       CASE WHEN t.tier_key IS NULL THEN printf({O.q(C.TPL_TIER_INVALID)}, f.requested_tier) END AS error
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'Gold' WHEN event_id % 10 < 4 THEN ' starter '
                            WHEN event_id % 10 < 7 THEN 'Professional' ELSE 'enterprise' END AS requested_tier
      FROM events) f
LEFT JOIN tiers t ON t.tier_key = {O.norm_sql('f.requested_tier')}"""
    ),
)
def q_tier_pricing_join(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events").select("event_id")
    df = ev.withColumn("requested_tier", FX.requested_tier(F.col("event_id")))
    df = A.join_tiers(df, FX.tiers(spark), "requested_tier")
    return df.select(
        "event_id",
        "requested_tier",
        "tier_key",
        "tier_name",
        "monthly_cost",
        "max_seats",
        "sla_hours",
        "tier_valid",
        F.when(~F.col("tier_valid"), F.format_string(C.TPL_TIER_INVALID, F.col("requested_tier"))).alias("error"),
    )


RESOLVED_KEEP = ("event_id", "idempotency_key", "subject", "execution_time_ms")


def resolved(spark, sf_dir) -> DataFrame:
    def build():
        i = inputs(spark, sf_dir)
        # the responses and routes never show the ticket body: it is not shuffled
        return TR.resolve(i.requests, i.accounts, i.tiers, keep=RESOLVED_KEEP)

    return shared(spark, "resolved", sf_dir, build=build)


@register(
    "balance_results",
    O.with_res(
        """SELECT key, ticket_id, account_id, acct_company_name AS company_name,
       CAST(acct_balance_usd AS DOUBLE) AS balance_usd, acct_currency AS currency,
       acct_overdue_invoices_count AS overdue_invoices_count,
       CAST(acct_overdue_amount_usd AS DOUBLE) AS overdue_amount_usd,
       CAST(acct_credit_limit_usd AS DOUBLE) AS credit_limit_usd, acct_status AS account_status,
       result_json
FROM res WHERE category = 'BILLING'"""
    ),
)
def q_balance_results(spark, sf_dir):
    df = resolved(spark, sf_dir).filter(F.col("category") == "BILLING")
    r = A.balance_result()
    return df.select(
        "key",
        "ticket_id",
        "account_id",
        r["company_name"].alias("company_name"),
        r["balance_usd"].alias("balance_usd"),
        r["currency"].alias("currency"),
        r["overdue_invoices_count"].alias("overdue_invoices_count"),
        r["overdue_amount_usd"].alias("overdue_amount_usd"),
        r["credit_limit_usd"].alias("credit_limit_usd"),
        r["status"].alias("account_status"),
        F.col("actions_taken")[0]["result"].alias("result_json"),
    )


@register(
    "tier_change_results",
    O.with_res(
        f"""SELECT key, ticket_id, account_id, previous_tier, tier_name AS new_tier,
       CAST(monthly_cost AS DOUBLE) AS monthly_cost_usd, max_seats, seats_after,
       strftime(created_at, '%Y-%m-%d') AS effective_date, confirmation_id,
       printf({O.q(C.TPL_TIER_MESSAGE)}, account_id, tier_name) AS message, result_json
FROM res WHERE is_change"""
    ),
)
def q_tier_change_results(spark, sf_dir):
    df = resolved(spark, sf_dir).filter(F.col("is_change"))
    r = A.tier_change_result()
    return df.select(
        "key",
        "ticket_id",
        "account_id",
        "previous_tier",
        r["new_tier"].alias("new_tier"),
        r["monthly_cost_usd"].alias("monthly_cost_usd"),
        "max_seats",
        "seats_after",
        r["effective_date"].alias("effective_date"),
        "confirmation_id",
        r["message"].alias("message"),
        F.col("actions_taken")[0]["result"].alias("result_json"),
    )


ACCOUNT_STATE_SQL = O.with_base(
    f"""SELECT coalesce(a.account_id, t.account_id) AS account_id,
       CASE WHEN a.account_id IS NOT NULL THEN a.company_name ELSE {O.q(C.DEFAULT_ACCOUNT['company_name_prefix'])} || t.account_id END AS company_name,
       coalesce(t.last_tier, CASE WHEN a.account_id IS NOT NULL THEN a.current_tier ELSE {O.q(C.DEFAULT_ACCOUNT['current_tier'])} END) AS current_tier,
       greatest(CASE WHEN a.account_id IS NOT NULL THEN a.seats_allocated ELSE {C.DEFAULT_ACCOUNT['seats_allocated']} END, t.max_half) AS seats_allocated,
       CAST(coalesce(t.tier_changes, 0) AS BIGINT) AS tier_changes,
       CAST(coalesce(t.tool_calls, 0) AS BIGINT) AS tool_calls,
       a.account_id IS NULL AS is_new
FROM accts a FULL OUTER JOIN (
  SELECT account_id, arg_max(tier_name, (created_at, ticket_id)) FILTER (WHERE is_change) AS last_tier,
         max(CASE WHEN is_change THEN max_seats // 2 END) AS max_half,
         count(*) FILTER (WHERE is_change) AS tier_changes, count(*) AS tool_calls
  FROM (SELECT d.*, {O.norm_sql('d.customer_id')} AS account_id, t.name AS tier_name, t.max_seats,
               (d.category = 'SUBSCRIPTION' AND t.tier_key IS NOT NULL) AS is_change
        FROM decided d LEFT JOIN tiers t ON t.tier_key = {O.norm_sql('d.target_tier')}
        WHERE d.category = 'BILLING' OR (d.category = 'SUBSCRIPTION' AND t.tier_key IS NOT NULL))
  GROUP BY account_id) t ON a.account_id = t.account_id"""
)


@register("account_state", ACCOUNT_STATE_SQL)
def q_account_state(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return A.account_state(i.accounts, reaching_calls(i)).select(*STATE_REPORT)


STATE_REPORT = ("account_id", "company_name", "current_tier", "seats_allocated", "tier_changes", "tool_calls", "is_new")


def reaching_calls(i: TR.Inputs) -> DataFrame:
    """The tool calls of each key's first request that reach an account, narrow."""
    category, target_tier, _ = TR.classify_columns()
    narrow = {"customer_id": F.col("customer_id"), "category": category, "target_tier": target_tier}
    d = first_fields(with_key(i.requests), narrow)
    calls = d.filter(F.col("category").isin("SUBSCRIPTION", "BILLING")).withColumn(
        "account_id", A.normalize_id("customer_id")
    )
    calls = A.join_tiers(calls, i.tiers, "target_tier").withColumn(
        "is_change", (F.col("category") == "SUBSCRIPTION") & F.col("tier_valid")
    )
    return A.tool_calls(calls)


@register(
    "response_text",
    O.with_res("SELECT key, ticket_id, category, status, confidence_score, reasoning, customer_reply FROM res"),
)
def q_response_text(spark, sf_dir):
    return resolved(spark, sf_dir).select(
        "key", "ticket_id", "category", "status", "confidence_score", "reasoning", "customer_reply"
    )


@register(
    "tool_dispatch",
    O.with_res(
        "SELECT key, ticket_id, tool_name, parameters_json, tool_success AS success, result_json "
        "FROM res WHERE tool_name IS NOT NULL"
    ),
)
def q_tool_dispatch(spark, sf_dir):
    df = resolved(spark, sf_dir).select("key", "ticket_id", F.explode("actions_taken").alias("a"))
    return df.select(
        "key",
        "ticket_id",
        F.col("a.tool_name").alias("tool_name"),
        F.to_json(F.col("a.parameters")).alias("parameters_json"),
        F.col("a.success").alias("success"),
        F.col("a.result").alias("result_json"),
    )


# ---------------------------------------------------------------- slice 4: ledger and audit

from ..operators import audit as AU  # noqa: E402
from ..operators import ledger as L  # noqa: E402
from ..sinks.points import lookup  # noqa: E402
from . import ledger_flow as LF  # noqa: E402

LEDGER_SELECT = ", ".join(L.LEDGER_COLUMNS)


def upserted(spark, sf_dir) -> DataFrame:
    """The ledger after the incoming batch (F4), the plan shared by the ledger reports."""
    return shared(spark, "upserted", sf_dir, build=lambda: LF.upserted(LF.prepare(spark, sf_dir)))


def stored_ledger(spark, sf_dir) -> DataFrame:
    """The upserted ledger as a table, written once per session; the reports scan the columns they show."""
    return LF.stored_ledger(LF.prepare(spark, sf_dir))


@register("seed_ledger", O.with_ledger(f"SELECT {LEDGER_SELECT} FROM seed"))
def q_seed_ledger(spark, sf_dir):
    return LF.prepare(spark, sf_dir).seed.select(*L.LEDGER_COLUMNS)


@register(
    "ledger_hits",
    O.with_ledger(
        "SELECT event_id, ticket_id, key, stored_ticket_id, stored_status, stored_confidence_score FROM hits"
    ),
)
def q_ledger_hits(spark, sf_dir):
    li = LF.prepare(spark, sf_dir)
    return L.hits(li.incoming, li.seed).select(
        "event_id", "ticket_id", "key", "stored_ticket_id", "stored_status", "stored_confidence_score"
    )


@register(
    "ledger_points",
    O.with_ledger(
        """SELECT a.key, s.idempotency_key IS NOT NULL AS found, s.ticket_id, s.status, s.confidence_score, s.category
FROM (SELECT DISTINCT key FROM (SELECT key FROM inc ORDER BY created_at, event_id LIMIT 100)) a
LEFT JOIN seed s ON s.idempotency_key = a.key AND s.status IN ('RESOLVED', 'ESCALATED')"""
    ),
)
def q_ledger_points(spark, sf_dir):
    """SRC-8: the stored outcomes of the 100 requests at the head of the queue, by point lookup."""
    li = LF.prepare(spark, sf_dir)
    head = li.incoming.orderBy("created_at", "event_id").limit(100).select("key").distinct()
    keys = [r.key for r in head.collect()]
    found = L.readable(lookup(LF.points(li), "idempotency_key", keys))
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    j = asked.join(found, F.col("key") == F.col("idempotency_key"), "left")
    return j.select("key", F.col("idempotency_key").isNotNull().alias("found"), "ticket_id", "status", "confidence_score", "category")


@register("new_tickets", O.with_ledger("SELECT key, event_id, ticket_id, created_at FROM new_firsts"))
def q_new_tickets(spark, sf_dir):
    li = LF.prepare(spark, sf_dir)
    firsts = first_fields(L.misses(li.incoming, li.seed), {"event_id": F.col("event_id")})
    return firsts.select("key", "event_id", "ticket_id", "created_at")


@register("ledger_upsert", O.with_ledger(f"SELECT {LEDGER_SELECT}, change FROM upserted"))
def q_ledger_upsert(spark, sf_dir):
    return upserted(spark, sf_dir)


REPORT_COLS = [
    "ticket_id",
    "customer_id",
    "subject",
    "category",
    "priority",
    "status",
    "confidence_score",
    "execution_time_ms",
    "cost_estimate_usd",
    "resolution_summary",
    "customer_reply",
    "actions_taken",
    "created_at",
]


@register(
    "ledger_report_scan",
    O.with_ledger(f"SELECT {', '.join(REPORT_COLS)} FROM upserted ORDER BY created_at DESC"),
)
def q_ledger_report_scan(spark, sf_dir):
    """SRC-2 + PRJ-1: 13 columns, newest first (column pruning reaches the plan)."""
    return stored_ledger(spark, sf_dir).select(*REPORT_COLS).orderBy(F.desc("created_at"))


@register(
    "ledger_display",
    O.with_ledger(
        "SELECT ticket_id, customer_id, category, priority, status, "
        "CAST(CAST(confidence_score AS DECIMAL(38,2)) AS VARCHAR) AS confidence_text, "
        "CAST(execution_time_ms AS VARCHAR) || ' ms' AS latency_text, subject FROM upserted"
    ),
)
def q_ledger_display(spark, sf_dir):
    return K.display_rows(stored_ledger(spark, sf_dir))


TICKET_LATEST_COLS = ["ticket_id", "customer_id", "subject", "status", "confidence_score", "resolution_summary",
                      "customer_reply", "execution_time_ms", "created_at", "updated_at"]


@register(
    "ticket_latest",
    O.with_ledger(
        f"SELECT {', '.join(TICKET_LATEST_COLS)} FROM upserted "
        "QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, updated_at DESC) = 1"
    ),
)
def q_ticket_latest(spark, sf_dir):
    return K.latest_per(stored_ledger(spark, sf_dir), "ticket_id", TICKET_LATEST_COLS)


AUDIT_STEPS_SQL = f"""audit AS (
  SELECT sha256(key) AS ticket_key, key AS idempotency_key, {O.q(C.STEP_INGESTION)} AS step_name, 'SUCCESS' AS status,
         CAST(1 AS DECIMAL(4,3)) AS confidence_score, 0 AS latency_ms,
         json_object('ticket_id', ticket_id, 'customer_id', customer_id, 'subject', subject)::VARCHAR AS input_payload,
         CAST(NULL AS VARCHAR) AS output_payload, CAST(NULL AS VARCHAR) AS error_message, created_at
  FROM gated
  UNION ALL
  SELECT sha256(key), key, {O.q(C.STEP_GATE)}, gate_status, CAST(confidence_score AS DECIMAL(4,3)),
         coalesce(execution_time_ms, 0), CAST(NULL AS VARCHAR),
         json_object('status', status, 'gate_decision', gate_message)::VARCHAR, CAST(NULL AS VARCHAR), created_at
  FROM gated)"""

AUDIT_SELECT = ", ".join(AU.AUDIT_COLUMNS)
AUDIT_KEEP = ["customer_id", "subject", "execution_time_ms"]  # the body is not logged


@register("audit_rows", O.with_base(f"SELECT {AUDIT_SELECT} FROM audit", [AUDIT_STEPS_SQL]))
def q_audit_rows(spark, sf_dir):
    return AU.step_rows(decided(spark, sf_dir, tuple(AUDIT_KEEP))).select(*AU.AUDIT_COLUMNS)


@register(
    "backfill_audit",
    O.with_ledger(
        f"""SELECT ticket_key, idempotency_key, {O.q(C.STEP_IDEMPOTENCY)} AS step_name, 'SUCCESS' AS status,
       CAST(1 AS DECIMAL(4,3)) AS confidence_score, 15 AS latency_ms,
       json_object('idempotency_key', idempotency_key)::VARCHAR AS input_payload,
       '{{"is_duplicate":false}}' AS output_payload, CAST(NULL AS VARCHAR) AS error_message,
       created_at - INTERVAL 300 MILLISECOND AS created_at
FROM seed
UNION ALL
SELECT ticket_key, idempotency_key, {O.q(C.STEP_INTENT)}, CASE WHEN status = 'RESOLVED' THEN 'SUCCESS' ELSE 'WARNING' END,
       confidence_score, execution_time_ms, json_object('subject', subject, 'body', body)::VARCHAR,
       '{{"status":' || to_json(status) || ',"confidence_score":' || coalesce(CAST(CAST(confidence_score AS DOUBLE) AS VARCHAR), 'null')
       || ',"actions":' || coalesce(actions_taken, 'null') || '}}',
       CAST(NULL AS VARCHAR), created_at
FROM seed"""
    ),
)
def q_backfill_audit(spark, sf_dir):
    return AU.backfill_rows(LF.prepare(spark, sf_dir).seed).select(*AU.AUDIT_COLUMNS)


@register(
    "audit_relink",
    O.with_ledger(
        """SELECT a.idempotency_key, a.step_name, CASE WHEN s.ticket_key IS NOT NULL THEN a.ticket_key END AS ticket_key,
       s.ticket_key IS NULL AS orphan
FROM audit a LEFT JOIN seed s ON s.idempotency_key = a.idempotency_key""",
        [AUDIT_STEPS_SQL],
    ),
)
def q_audit_relink(spark, sf_dir):
    audit = AU.step_rows(decided(spark, sf_dir, tuple(AUDIT_KEEP)))
    return AU.relink(audit, LF.prepare(spark, sf_dir).seed).select("idempotency_key", "step_name", "ticket_key", "orphan")


# ---------------------------------------------------------------- slice 5: contracts and feeds

from ..operators import contract as CT  # noqa: E402
from ..operators import model_feed as MF  # noqa: E402
from ..operators import model_path as MP  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..operators.gate import exception_outcome  # noqa: E402
from ..sources import feeds as FD  # noqa: E402


def events(spark, sf_dir) -> DataFrame:
    return FX.table(spark, sf_dir, "events")


REQ_JSON_SQL = """rq AS (
  SELECT event_id, CASE WHEN event_id % 47 = 0 THEN 'x' ELSE '' END
         || json_object('ticket_id', ticket_id, 'customer_id', customer_id, 'subject', subject, 'body', body,
                        'idempotency_key', idempotency_key)::VARCHAR AS value
  FROM f1)"""


@register(
    "ingest_requests",
    O.with_base(
        """SELECT event_id,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.ticket_id') END AS ticket_id,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.customer_id') END AS customer_id,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.subject') END AS subject,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.body') END AS body,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.idempotency_key') END AS idempotency_key,
       NOT json_valid(value) AS is_corrupt
FROM rq""",
        [REQ_JSON_SQL],
    ),
)
def q_ingest_requests(spark, sf_dir):
    parsed = FD.parse_requests(FD.request_json(events(spark, sf_dir)))
    return parsed.select("event_id", "ticket_id", "customer_id", "subject", "body", "idempotency_key", "is_corrupt")


@register(
    "request_contract",
    O.with_base(f"SELECT event_id, {O.violations_sql(O.REQUEST_RULES_SQL)} FROM f8", [O.F8_CTE]),
)
def q_request_contract(spark, sf_dir):
    df = CT.check(FX.broken_requests(events(spark, sf_dir)), CT.request_rules())
    return df.select("event_id", "violation_text", "n_violations")


def _ledger_candidates(f8: DataFrame) -> DataFrame:
    """F8 as ledger rows as they would be inserted (CON-6 defaults for omitted columns)."""
    # The contract must see a missing key, so none is made up here.
    return f8.withColumn("key", effective_key()).select(
        "event_id",
        F.col("key").alias("idempotency_key"),
        "ticket_id",
        "customer_id",
        F.lit(None).cast("string").alias("customer_email"),
        "subject",
        "body",
        F.lit(C.DEFAULT_CATEGORY).alias("category"),
        "priority",
        F.lit(C.DEFAULT_STATUS).alias("status"),
        "confidence_raw",
    )


@register(
    "ledger_contract",
    O.with_base(
        f"""SELECT event_id, {O.violations_sql(O.ledger_rules_sql())}
FROM (SELECT event_id, coalesce(nullif(idempotency_key, ''), ticket_id) AS idempotency_key, ticket_id, customer_id,
             CAST(NULL AS VARCHAR) AS customer_email, subject, body, {O.q(C.DEFAULT_CATEGORY)} AS category, priority,
             {O.q(C.DEFAULT_STATUS)} AS status, confidence_raw FROM f8)""",
        [O.F8_CTE],
    ),
)
def q_ledger_contract(spark, sf_dir):
    df = CT.check(_ledger_candidates(FX.broken_requests(events(spark, sf_dir))), CT.ledger_rules())
    return df.select("event_id", "violation_text", "n_violations")


@register(
    "audit_contract",
    O.with_base(
        f"SELECT idempotency_key, step_name, {O.violations_sql(O.AUDIT_RULES_SQL)} FROM audit",
        [AUDIT_STEPS_SQL],
    ),
)
def q_audit_contract(spark, sf_dir):
    audit = AU.step_rows(decided(spark, sf_dir, tuple(AUDIT_KEEP)))
    return CT.check(audit, CT.audit_rules()).select("idempotency_key", "step_name", "violation_text", "n_violations")


@register(
    "response_contract",
    O.with_res(
        f"""SELECT key, {O.violations_sql([
            ("CONFIDENCE_RANGE", "confidence_score < 0 OR confidence_score > 1"),
            ("STATUS_DOMAIN", "coalesce(status IN (" + ", ".join(O.q(x) for x in C.RESPONSE_STATUSES) + "), false) = false"),
            ("ACTION_INCOMPLETE", "tool_name IS NOT NULL AND tool_success IS NULL"),
        ])} FROM res"""
    ),
)
def q_response_contract(spark, sf_dir):
    return CT.check(resolved(spark, sf_dir), CT.response_rules()).select("key", "violation_text", "n_violations")


@register(
    "audit_intake",
    O.with_base(
        f"""SELECT event_id, step_name, status, latency_ms, input_payload, {O.violations_sql(O.AUDIT_RULES_SQL)}
FROM (SELECT * REPLACE (coalesce(latency_ms, 0) AS latency_ms) FROM f10)""",
        [O.F10_CTE],
    ),
)
def q_audit_intake(spark, sf_dir):
    """CON-3, CON-10, SCL-20 over arriving audit entries, broken ones among them."""
    entries = AU.entry_rows(FX.audit_entries(events(spark, sf_dir)))
    return CT.check(entries, CT.audit_rules()).select("event_id", "step_name", "status", "latency_ms", "input_payload", "violation_text", "n_violations")


@register("response_intake", O.with_base(f"SELECT event_id, {O.violations_sql(O.RESPONSE_RULES_SQL)} FROM f11", [O.F11_CTE]))
def q_response_intake(spark, sf_dir):
    """CON-9 over arriving responses, broken ones among them."""
    return CT.check(FX.model_service_responses(events(spark, sf_dir)), CT.response_rules()).select("event_id", "violation_text", "n_violations")


def count_rows(spark: SparkSession, counts: dict[str, dict[str, int]]) -> DataFrame:
    """contract, rule, n_rows of observed counts: one row for each rule."""
    listed = [(contract, rule, n) for contract, of in counts.items() for rule, n in of.items()]
    return spark.createDataFrame(listed, "contract string, rule string, n_rows long")


CONTRACT_COUNTS_SQL = {
    "request": O.counts_sql("request", "f8", O.REQUEST_RULES_SQL),
    "audit": O.counts_sql("audit", "f10", O.AUDIT_RULES_SQL),
    "response": O.counts_sql("response", "f11", O.RESPONSE_RULES_SQL),
}


@register("contract_counts", O.with_base("\nUNION ALL\n".join(CONTRACT_COUNTS_SQL.values()), [O.F8_CTE, O.F10_CTE, O.F11_CTE]))
def q_contract_counts(spark, sf_dir):
    """CON-1, CON-3, CON-9: rows, broken rows and rows of each rule, observed while good rows and quarantine are written."""
    ev = events(spark, sf_dir)
    feeds = {
        "request": (FX.broken_requests(ev), CT.request_rules()),
        "audit": (AU.entry_rows(FX.audit_entries(ev)), CT.audit_rules()),
        "response": (FX.model_service_responses(ev), CT.response_rules()),
    }
    return count_rows(spark, {name: CT.store_checked(CT.check(df, rules), rules, scratch_path(spark, f"checked-{name}")) for name, (df, rules) in feeds.items()})


@register(
    "column_defaults",
    O.with_base(
        f"""SELECT key AS idempotency_key, ticket_id, CASE event_id % 3 WHEN 0 THEN {O.q(C.DEFAULT_CATEGORY)} WHEN 2 THEN 'BILLING' END AS category,
       CASE event_id % 3 WHEN 0 THEN {O.q(C.DEFAULT_PRIORITY)} WHEN 2 THEN 'HIGH' END AS priority, CASE event_id % 3 WHEN 0 THEN {O.q(C.DEFAULT_STATUS)} WHEN 2 THEN 'RESOLVED' END AS status,
       CASE WHEN event_id % 3 <> 1 THEN '[]' END AS actions_taken, CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 2 THEN execution_time_ms END AS INTEGER) AS execution_time_ms,
       CASE WHEN event_id % 3 <> 1 THEN CAST(0.0300 AS DECIMAL(6,4)) END AS cost_estimate_usd FROM firsts"""
    ),
)
def q_column_defaults(spark, sf_dir):
    """CON-6: first tickets inserted with the columns left out, given as null, or given in part."""
    first = first_fields(with_key(requests(spark, sf_dir)), {c: F.col(c) for c in ("event_id", "execution_time_ms")}).withColumnRenamed("key", "idempotency_key")
    first = LF.as_table(first, "defaults-firsts")
    kind, keys = F.col("event_id") % 3, ["idempotency_key", "ticket_id"]
    nulls = [F.lit(None).cast(t).alias(c) for c, (t, _) in L.DEFAULTS.items()]
    some = [F.lit("BILLING").alias("category"), F.lit("HIGH").alias("priority"), F.lit("RESOLVED").alias("status"), "execution_time_ms"]
    parts = [first.filter(kind == 0).select(*keys), first.filter(kind == 1).select(*keys, *nulls), first.filter(kind == 2).select(*keys, *some)]
    return L.insert_rows(parts, scratch_path(spark, "defaults"))


MODEL_OUT_SQL = f"""mo AS (
  SELECT event_id, v,
         CASE WHEN v THEN json_extract_string(output_json, '$.category') END AS category,
         CASE WHEN v THEN json_extract_string(output_json, '$.priority') END AS priority0,
         CASE WHEN v THEN TRY_CAST(json_extract(output_json, '$.confidence_score') AS DOUBLE) END AS conf,
         CASE WHEN v THEN TRY_CAST(json_extract(output_json, '$.requires_escalation') AS BOOLEAN) END AS req_esc,
         CASE WHEN v THEN json_extract_string(output_json, '$.reasoning') END AS reasoning,
         CASE WHEN v THEN json_extract_string(output_json, '$.customer_reply') END AS reply
  FROM (SELECT *, json_valid(output_json) AS v FROM f6))"""

MODEL_RULES_SQL = [
    ("MALFORMED_JSON", "NOT v"),
    ("CATEGORY_REQUIRED", "v AND category IS NULL"),
    ("CONFIDENCE_REQUIRED", "v AND conf IS NULL"),
    ("CONFIDENCE_RANGE", "conf < 0 OR conf > 1"),
    ("ESCALATION_FLAG_REQUIRED", "v AND req_esc IS NULL"),
    ("REASONING_REQUIRED", "v AND reasoning IS NULL"),
    ("CUSTOMER_REPLY_REQUIRED", "v AND reply IS NULL"),
    ("PRIORITY_DOMAIN", "priority0 IS NOT NULL AND priority0 NOT IN (" + ", ".join(O.q(x) for x in C.TICKET_PRIORITIES) + ")"),
]


@register(
    "model_output_contract",
    O.with_base(
        f"""SELECT event_id, category, coalesce(priority0, {O.q(C.DEFAULT_PRIORITY)}) AS priority, conf AS model_confidence,
       violation_text, n_violations,
       CASE WHEN n_violations > 0 THEN 'ESCALATED' WHEN req_esc OR conf < {C.CONFIDENCE_THRESHOLD} THEN 'ESCALATED' ELSE 'RESOLVED' END AS status
FROM (SELECT *, {O.violations_sql(MODEL_RULES_SQL)} FROM mo)""",
        [O.F6_CTE, MODEL_OUT_SQL],
    ),
)
def q_model_output_contract(spark, sf_dir):
    df = MF.judge_output(FX.model_responses(events(spark, sf_dir)))
    return df.select("event_id", "category", "priority", "model_confidence", "violation_text", "n_violations", "status")


_KNOWN = ", ".join(O.q(t) for t in sorted(MF.REQUIRED_ARGS))
_CALL_OK = " OR ".join(
    "(json_extract_string(x, '$.name') = " + O.q(t) + " AND "
    + " AND ".join(f"json_extract_string(x, '$.args.{a}') IS NOT NULL" for a in args) + ")"
    for t, args in MF.REQUIRED_ARGS.items()
)


@register(
    "model_response_actions",
    O.with_base(
        f"""SELECT event_id, CAST(n_calls AS INTEGER) AS n_calls, CAST(len(kept) AS INTEGER) AS n_actions,
       confidence_score, 'GENERAL' AS category,
       CASE WHEN confidence_score < {O.THR} THEN 'ESCALATED' ELSE 'RESOLVED' END AS status,
       {O.q(C.MODEL_REASONING + " [")} || {O.gate_msg_sql('confidence_score')} || ']' AS reasoning,
       coalesce(nullif(content, ''), {O.q(C.MODEL_DEFAULT_REPLY)}) AS customer_reply
FROM (SELECT *, CAST(CASE WHEN len(kept) > 0 AND list_bool_and(list_transform(kept, lambda x: {_CALL_OK}))
                     THEN {C.CONF_MODEL_ALL_OK} ELSE {C.CONF_MODEL_OTHER} END AS DECIMAL(4,3)) AS confidence_score
      FROM (SELECT event_id, json_extract_string(message_json, '$.content') AS content,
                   coalesce(json_array_length(message_json, '$.tool_calls'), 0) AS n_calls,
                   coalesce(list_filter(CAST(json_extract(message_json, '$.tool_calls[*]') AS JSON[]),
                               lambda x: json_extract_string(x, '$.name') IN ({_KNOWN})), []) AS kept
            FROM f6))""",
        [O.F6_CTE],
    ),
)
def q_model_response_actions(spark, sf_dir):
    df = MF.model_actions(FX.model_responses(events(spark, sf_dir)))
    return df.select(
        "event_id",
        F.col("_n_calls").alias("n_calls"),
        F.size("_actions").alias("n_actions"),
        "confidence_score",
        "category",
        "status",
        "reasoning",
        "customer_reply",
    )


def _model_tickets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """First model tickets per key, and their tool calls after they ran."""
    tickets = first_per_key(with_key(FX.model_messages(events(spark, sf_dir))))
    accounts = FX.accounts(FX.table(spark, sf_dir, "customer"))
    return tickets, MP.run_calls(MP.call_rows(tickets), accounts, FX.tiers(spark))


@register("model_ledger_rows", O.with_base(f"SELECT {LEDGER_SELECT} FROM model_rows", O.MODEL_PATH_CTES))
def q_model_ledger_rows(spark, sf_dir):
    tickets, calls = _model_tickets(spark, sf_dir)
    return L.ledger_rows(MP.answered(tickets, calls)).select(*L.LEDGER_COLUMNS)


@register("model_account_state", O.with_base(O.MODEL_STATE_SQL, O.MODEL_PATH_CTES))
def q_model_account_state(spark, sf_dir):
    _, calls = _model_tickets(spark, sf_dir)
    state = A.account_state(FX.accounts(FX.table(spark, sf_dir, "customer")), MP.reaching(calls), MP.CALL_ORDER)
    return state.select("account_id", "company_name", "current_tier", "seats_allocated", "tier_changes", "tool_calls", "is_new")


@register("failed_tier_change", O.with_base(O.FAILED_TIER_SQL, O.ASKED_TIER_CTES))
def q_failed_tier_change(spark, sf_dir):
    """SCL-7, SCL-13, SCL-32: subscription tickets that ask for the tier of a column (F3), some of them for one that is not on the list."""
    i = TR.load(spark, sf_dir)
    asked = i.requests.withColumn("asked_tier", FX.requested_tier(F.col("event_id")))
    df = TR.resolve(asked, i.accounts, i.tiers, tier_col="asked_tier").filter("category = 'SUBSCRIPTION'")
    audit = AU.step_rows(df).filter(F.col("step_name") == C.STEP_GATE).select(F.col("idempotency_key").alias("key"), F.col("status").alias("audit_status"), "output_payload")
    # A rejected tier never reads the account.
    moved = [F.when(F.col("tier_valid"), F.col(c)).alias(c) for c in ("previous_tier", "seats_after")]
    rows = df.select(
        "key", "target_tier", "tier_valid", "confidence_score", "status", *moved, "reasoning", "customer_reply", L.actions_json().alias("actions_taken")
    )
    return rows.join(audit, "key")


@register(
    "normalize_actions",
    O.with_base(
        """SELECT event_id, CAST(i AS INTEGER) AS pos,
       coalesce(json_extract_string(a, '$.tool'), json_extract_string(a, '$.tool_name'), 'unknown') AS tool_name,
       coalesce(json_extract_string(a, '$.status') = 'SUCCESS', false)
         OR coalesce(CAST(json_extract(a, '$.success') AS BOOLEAN), true) AS success,
       coalesce(CAST(json_extract(a, '$.parameters') AS VARCHAR), '{}') AS parameters_json,
       coalesce(CAST(json_extract(a, '$.details') AS VARCHAR), CAST(json_extract(a, '$.result') AS VARCHAR), '{}') AS result_json,
       json_extract_string(a, '$.error') AS error
FROM (SELECT event_id, i, json_extract(actions_json, '$[' || i || ']') AS a
      FROM f5, range(CAST(json_array_length(actions_json) AS BIGINT)) r(i))""",
        [O.F5_CTE],
    ),
)
def q_normalize_actions(spark, sf_dir):
    df = MF.normalize_actions(FX.stored_actions(events(spark, sf_dir)))
    return df.select("event_id", "pos", "tool_name", "success", "parameters_json", "result_json", "error")


@register("feed_files", O.with_base(O.FEED_SQL))
def q_feed_files(spark, sf_dir):
    path = FD.write_lines(FD.request_lines(events(spark, sf_dir)), scratch_path(spark, "feed"), 16)
    return FD.feed_report(FD.read_requests(spark, path))


@register(
    "workflow_failures",
    O.with_base("SELECT * FROM failures", [O.F7_CTE, O.FAILURES_CTE]),
)
def q_workflow_failures(spark, sf_dir):
    return FD.parse_failures(FX.workflow_failures_raw(events(spark, sf_dir)))


def failure_audit(failures: DataFrame) -> DataFrame:
    """SNK-8: one audit row per workflow failure (no ticket link)."""
    return failures.select(
        F.lit(None).cast("string").alias("ticket_key"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.lit(C.STEP_WORKFLOW_FAILURE).alias("step_name"),
        F.lit("ERROR").alias("status"),
        F.lit(0).cast("decimal(4,3)").alias("confidence_score"),
        F.lit(0).alias("latency_ms"),
        F.to_json(F.struct("execution_id")).alias("input_payload"),
        F.to_json(F.struct(F.col("workflow_name").alias("workflow"))).alias("output_payload"),
        "error_message",
        F.col("failed_at").alias("created_at"),
    )


@register(
    "failure_audit_rows",
    O.with_base(
        f"""SELECT CAST(NULL AS VARCHAR) AS ticket_key, CAST(NULL AS VARCHAR) AS idempotency_key, step_name,
       'ERROR' AS status, CAST(0 AS DECIMAL(4,3)) AS confidence_score, 0 AS latency_ms,
       json_object('execution_id', execution_id)::VARCHAR AS input_payload,
       json_object('workflow', workflow_name)::VARCHAR AS output_payload, error_message, failed_at AS created_at
FROM failures""",
        [O.F7_CTE, O.FAILURES_CTE],
    ),
)
def q_failure_audit_rows(spark, sf_dir):
    return failure_audit(FD.parse_failures(FX.workflow_failures_raw(events(spark, sf_dir))))


FALLBACK_SQL = O.with_base(
        f"""SELECT coalesce(nullif(idempotency_key, ''), ticket_id) AS key, event_id, ticket_id, 'ESCALATED' AS status,
       'TECHNICAL' AS category, CAST(0 AS DECIMAL(4,3)) AS confidence_score,
       printf({O.q(C.TPL_EXC_REASONING)}, 'invalid request: ' || violation_text) AS reasoning,
       printf({O.q(C.TPL_EXC_REPLY)}, coalesce(subject, ''), coalesce(ticket_id, '')) AS customer_reply, violation_text
FROM (SELECT *, {O.violations_sql(O.REQUEST_RULES_SQL)} FROM f8) WHERE n_violations > 0""",
        [O.F8_CTE],
)


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CON-1 in the flow: (requests that keep the contract, the others with the error that STR-6 reports)."""
    good, bad = CT.split(CT.check(requests, CT.request_rules()))
    bad = bad.withColumns({"key": effective_key(), "error": F.concat(F.lit("invalid request: "), F.col("violation_text"))})
    return good, bad


def fallback_outcomes(bad: DataFrame) -> DataFrame:
    """STR-6: the escalated response of every request that breaks the contract."""
    bad = bad.withColumns(
        {
            "subject": F.coalesce(F.col("subject"), F.lit("")),
            "ticket_id_text": F.coalesce(F.col("ticket_id"), F.lit("")),
        }
    )
    out = exception_outcome("error")
    out["customer_reply"] = F.format_string(C.TPL_EXC_REPLY, F.col("subject"), F.col("ticket_id_text"))
    return bad.select(
        "key",
        "event_id",
        "ticket_id",
        out["status"].alias("status"),
        out["category"].alias("category"),
        out["confidence_score"].alias("confidence_score"),
        out["reasoning"].alias("reasoning"),
        out["customer_reply"].alias("customer_reply"),
        "violation_text",
    )


@register("fallback_rows", FALLBACK_SQL)
def q_fallback_rows(spark, sf_dir):
    return fallback_outcomes(split_requests(FX.broken_requests(events(spark, sf_dir)))[1])


@register(
    "fallback_audit_rows",
    O.with_base(
        f"""SELECT sha256(key) AS ticket_key, key AS idempotency_key, step_name, status, confidence_score, latency_ms, input_payload,
       output_payload, error_message, created_at
FROM (SELECT *, coalesce(nullif(idempotency_key, ''), ticket_id) AS key, {O.violations_sql(O.REQUEST_RULES_SQL)} FROM f8) b,
  LATERAL (
    SELECT {O.q(C.STEP_INGESTION)} AS step_name, 'SUCCESS' AS status, CAST(1 AS DECIMAL(4,3)) AS confidence_score, 0 AS latency_ms,
           json_object('ticket_id', b.ticket_id, 'customer_id', b.customer_id, 'subject', b.subject)::VARCHAR AS input_payload,
           CAST(NULL AS VARCHAR) AS output_payload, CAST(NULL AS VARCHAR) AS error_message
    UNION ALL
    SELECT {O.q(C.STEP_FALLBACK)}, 'WARNING', CAST(0 AS DECIMAL(4,3)), coalesce(b.execution_time_ms, 0), CAST(NULL AS VARCHAR),
           json_object('action', {O.q(C.EXC_ACTION)})::VARCHAR, 'invalid request: ' || b.violation_text) s
WHERE n_violations > 0""",
        [O.F8_CTE],
    ),
)
def q_fallback_audit_rows(spark, sf_dir):
    _, bad = split_requests(FX.broken_requests(events(spark, sf_dir)))
    return AU.fallback_step_rows(bad).select(*AU.AUDIT_COLUMNS)


# ---------------------------------------------------------------- slice 6: routing

from ..operators import routing as RT  # noqa: E402


@register(
    "route_counts",
    O.with_ledger(
        """SELECT CASE WHEN status = 'RESOLVED' THEN 'resolution_card' WHEN status = 'ESCALATED' THEN 'escalation_task'
            ELSE 'UNROUTED' END AS route, CAST(count(*) AS BIGINT) AS n_tickets
FROM upserted GROUP BY 1"""
    ),
)
def q_route_counts(spark, sf_dir):
    return RT.route_counts(stored_ledger(spark, sf_dir))


def _pct_sql(c: str) -> str:
    return f"{O.fixed_sql(c + ' * 100', 1)} || '%'"


_ACTIONS_RES = O.ACTIONS_JSON_SQL


def _card_sql() -> str:
    return f"""json_object('channel', {O.q(C.RESOLUTION_CHANNEL)}, 'text', printf({O.q(C.RESOLUTION_TITLE)}, ticket_id),
  'attachments', json_array(json_object('color', {O.q(RT.RESOLUTION_COLOR)}, 'fields', json_array(
     json_object('title', 'Category', 'value', category, 'short', true),
     json_object('title', 'Confidence Score', 'value', {_pct_sql('confidence_score')}, 'short', true),
     json_object('title', 'Actions Executed', 'value', {_ACTIONS_RES}, 'short', false),
     json_object('title', 'Drafted Customer Reply', 'value', customer_reply, 'short', false)))))::VARCHAR"""


def _task_sql() -> str:
    return f"""json_object('name', printf({O.q(C.ESCALATION_NAME)}, ticket_id, category),
  'description', printf({O.q(C.ESCALATION_DESCRIPTION)}, reasoning, {_pct_sql('confidence_score')}, customer_reply),
  'priority', 1, 'tags', json_array({', '.join(O.q(t) for t in C.ESCALATION_TAGS)}, lower(category)))::VARCHAR"""


@register(
    "resolution_cards",
    O.with_res(
        f"""SELECT key, ticket_id, {O.q(C.RESOLUTION_CHANNEL)} AS channel, printf({O.q(C.RESOLUTION_TITLE)}, ticket_id) AS text,
       category, {_pct_sql('confidence_score')} AS confidence_text, {_ACTIONS_RES} AS actions_text, customer_reply
FROM res WHERE status = 'RESOLVED'"""
    ),
)
def q_resolution_cards(spark, sf_dir):
    df = RT.with_route(resolved(spark, sf_dir)).filter(F.col("route") == "resolution_card")
    card = RT.resolution_card(L.actions_json())
    return df.select(
        "key",
        "ticket_id",
        card["channel"].alias("channel"),
        card["text"].alias("text"),
        "category",
        card["attachments"][0]["fields"][1]["value"].alias("confidence_text"),
        card["attachments"][0]["fields"][2]["value"].alias("actions_text"),
        "customer_reply",
    )


@register(
    "escalation_tasks",
    O.with_res(
        f"""SELECT key, ticket_id, printf({O.q(C.ESCALATION_NAME)}, ticket_id, category) AS name,
       printf({O.q(C.ESCALATION_DESCRIPTION)}, reasoning, {_pct_sql('confidence_score')}, customer_reply) AS description,
       1 AS priority, {O.q(','.join(C.ESCALATION_TAGS))} || ',' || lower(category) AS tags
FROM res WHERE status = 'ESCALATED'"""
    ),
)
def q_escalation_tasks(spark, sf_dir):
    df = RT.with_route(resolved(spark, sf_dir)).filter(F.col("route") == "escalation_task")
    task = RT.escalation_task()
    return df.select(
        "key",
        "ticket_id",
        task["name"].alias("name"),
        task["description"].alias("description"),
        task["priority"].alias("priority"),
        F.array_join(task["tags"], ",").alias("tags"),
    )


@register(
    "ops_alerts",
    O.with_base(
        f"""SELECT {O.q(C.ALERT_CHANNEL)} AS channel, {O.q(C.ALERT_TEXT)} AS text, {O.q(RT.ALERT_COLOR)} AS color,
       printf({O.q(C.ALERT_TITLE)}, workflow_name, execution_id) AS title, error_message,
       strftime(failed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS failed_at, {O.q(C.ALERT_AUDIT_STATUS)} AS audit_status,
       json_object('channel', {O.q(C.ALERT_CHANNEL)}, 'text', {O.q(C.ALERT_TEXT)}, 'attachments', json_array(json_object(
         'color', '#ef4444', 'title', printf({O.q(C.ALERT_TITLE)}, workflow_name, execution_id), 'fields', json_array(
           json_object('title', 'Error Message', 'value', error_message, 'short', false),
           json_object('title', 'Failed At', 'value', strftime(failed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'short', true),
           json_object('title', 'Audit Status', 'value', {O.q(C.ALERT_AUDIT_STATUS)}, 'short', true)))))::VARCHAR AS alert_json
FROM failures""",
        [O.F7_CTE, O.FAILURES_CTE],
    ),
)
def q_ops_alerts(spark, sf_dir):
    f = FD.parse_failures(FX.workflow_failures_raw(events(spark, sf_dir)))
    a, one = F.col("a"), F.col("a")["attachments"][0]
    return f.select(RT.ops_alert().alias("a")).select(
        a["channel"].alias("channel"),
        a["text"].alias("text"),
        one["color"].alias("color"),
        one["title"].alias("title"),
        one["fields"][0]["value"].alias("error_message"),
        one["fields"][1]["value"].alias("failed_at"),
        one["fields"][2]["value"].alias("audit_status"),
        F.to_json(a, {"ignoreNullFields": "false"}).alias("alert_json"),
    )


@register(
    "repeat_replies",
    O.with_ledger(
        f"""SELECT event_id, key, stored_ticket_id,
       json_object('ticket_id', stored_ticket_id, 'status', stored_status, 'cached', true, 'note', {O.q(C.CACHED_NOTE)})::VARCHAR AS reply_json,
       coalesce(stored_confidence_score, CAST(1 AS DECIMAL(4,3))) AS confidence_score,
       coalesce(stored_category, {O.q(C.DEFAULT_CATEGORY)}) AS category,
       {O.q(C.CACHED_REASONING_PREFIX)} || coalesce(stored_resolution_summary, 'None') AS reasoning,
       coalesce(stored_customer_reply, '') AS customer_reply, coalesce(stored_execution_time_ms, 0) AS latency_ms,
       {O.CACHED_ACTIONS_SQL} AS actions_taken
FROM hits"""
    ),
)
def q_repeat_replies(spark, sf_dir):
    li = LF.prepare(spark, sf_dir)
    h = L.hits(li.incoming, li.seed)
    return h.select("event_id", "key", "stored_ticket_id", RT.repeat_reply().alias("reply_json"), *L.cached_columns())


@register(
    "response_json",
    O.with_res(
        f"""SELECT key, ticket_id,
       left(json_object('ticket_id', ticket_id, 'idempotency_key', key, 'status', status,
                        'confidence_score', CAST(confidence_score AS DOUBLE), 'category', category, 'reasoning', reasoning)::VARCHAR,
            -1)
       || ',"actions_taken":' || {_ACTIONS_RES} || ','
       || substr(json_object('customer_reply', customer_reply, 'latency_ms', execution_time_ms, 'cached', false)::VARCHAR, 2)
       AS response
FROM res"""
    ),
)
def q_response_json(spark, sf_dir):
    df = resolved(spark, sf_dir)
    return df.select("key", "ticket_id", RT.response_json(L.actions_json()).alias("response"))


ROUTE_MESSAGES_SQL = O.with_res(
    f"""SELECT key, ticket_id, 'resolution_card' AS route, {_card_sql()} AS message FROM res WHERE status = 'RESOLVED'
UNION ALL
SELECT key, ticket_id, 'escalation_task' AS route, {_task_sql()} AS message FROM res WHERE status = 'ESCALATED'"""
)


@register("route_messages", ROUTE_MESSAGES_SQL)
def q_route_messages(spark, sf_dir):
    """SET-3: the two route branches merged into one reply stream.

    One pass: each routed row gets its branch's message from the one
    ``route`` column.  A union of two filters of the same plan would run
    everything above the shared shuffles (final dedupe, joins, texts) twice.
    """
    df = RT.with_route(resolved(spark, sf_dir)).filter(F.col("route").isin("resolution_card", "escalation_task"))
    return df.select("key", "ticket_id", "route", RT.route_message(L.actions_json()).alias("message"))


# ---------------------------------------------------------------- slice 7: streams (compared with their batch twins)

from ..streaming import jobs as SJ  # noqa: E402


@register(
    "stream_triage",
    O.with_base(
        f"""SELECT event_id, ticket_id, key, category, target_tier, confidence_score,
       CASE WHEN confidence_score < {O.THR} THEN 'ESCALATED' ELSE 'RESOLVED' END AS status
FROM (SELECT *, {O.confidence_sql('category')} AS confidence_score
      FROM (SELECT *, {O.category_sql('mt')} AS category,
                   CASE WHEN {O.category_sql('mt')} = 'SUBSCRIPTION' THEN {O.tier_sql('mt')} END AS target_tier
            FROM (SELECT *, lower(subject || ' ' || body) AS mt FROM keyed)))"""
    ),
)
def q_stream_triage(spark, sf_dir):
    return SJ.triage_stream(spark, sf_dir, SJ.new_run(spark, "stream_triage"))


@register("stream_feed", ORACLE["feed_files"])
def q_stream_feed(spark, sf_dir):
    run = SJ.new_run(spark, "stream_feed")
    path = FD.write_lines(FD.request_lines(events(spark, sf_dir)), f"{run.root}/lines", 16)
    return SJ.feed_stream(spark, path, run, max_files=4)


@register("stream_dedupe", ORACLE["dedupe_first"])
def q_stream_dedupe(spark, sf_dir):
    return SJ.dedupe_stream(spark, sf_dir, SJ.new_run(spark, "stream_dedupe"))


@register("stream_redeliveries", O.with_base(O.REDELIVERIES_SQL, [O.F12_CTE]))
def q_stream_redeliveries(spark, sf_dir):
    """F12 slot by slot; the stream stops after each slot and starts again from its checkpoint."""
    run = SJ.new_run(spark, "stream_redeliveries")
    narrow = with_key(requests(spark, sf_dir)).select("event_id", "key", "ticket_id", "created_at")
    FX.deliveries(narrow).write.partitionBy("slot").parquet(f"{run.root}/slots")
    slots = spark.read.parquet(f"{run.root}/slots")
    once = None
    for (slot,) in slots.select("slot").distinct().orderBy("slot").collect():  # one row for each four days
        slots.filter(F.col("slot") == slot).drop("slot").write.mode("append").parquet(f"{run.root}/feed")
        once = SJ.redelivery_stream(spark, f"{run.root}/feed", narrow.schema, run, "2 days")
    if once is None:
        return slots.selectExpr("event_id", "key AS outcome", "event_id AS n_copies")
    feed = spark.read.schema(narrow.schema).parquet(f"{run.root}/feed")
    passed = feed.groupBy("event_id").agg(F.count("*").alias("n_copies")).join(once.select("event_id"), "event_id")
    outcome = lambda name: F.lit(name).alias("outcome")
    return passed.select("event_id", outcome("PASSED"), "n_copies").unionAll(SJ.late_rows(feed, once).select("event_id", outcome("LATE"), "n_copies"))


@register("stream_ledger", O.with_res(f"SELECT {LEDGER_SELECT} FROM ({O.ledger_rows_sql('res')})"))
def q_stream_ledger(spark, sf_dir):
    job = SJ.ledger_stream(spark, sf_dir, SJ.new_run(spark, "stream_ledger"))
    return job.ledger.read().select(*L.LEDGER_COLUMNS)


@register("stream_account_state", ACCOUNT_STATE_SQL)
def q_stream_account_state(spark, sf_dir):
    job = SJ.ledger_stream(spark, sf_dir, SJ.new_run(spark, "stream_account_state"))
    return job.state.read().select(
        "account_id", "company_name", "current_tier", "seats_allocated", "tier_changes", "tool_calls", "is_new"
    )


@register("stream_account_fold", ACCOUNT_STATE_SQL)
def q_stream_account_fold(spark, sf_dir):
    """Tool calls before and from the cut-off of F4; the second part starts from the checkpoint of the first."""
    i, run = inputs(spark, sf_dir), SJ.new_run(spark, "stream_account_fold")
    calls = LF.as_table(reaching_calls(i), "account-fold-calls")
    for part in (F.col("created_at") < LF.cutoff(), ~F.coalesce(F.col("created_at") < LF.cutoff(), F.lit(False))):
        calls.filter(part).write.mode("append").parquet(f"{run.root}/calls")
        state = SJ.account_fold_stream(spark, f"{run.root}/calls", i.accounts, run)
    return state.select(*STATE_REPORT)


@register("stream_failures", ORACLE["failure_audit_rows"])
def q_stream_failures(spark, sf_dir):
    audit_root, _ = SJ.failure_stream(spark, sf_dir, SJ.new_run(spark, "stream_failures"))
    return spark.read.parquet(audit_root).select(*AU.AUDIT_COLUMNS)


@register("stream_routes", ROUTE_MESSAGES_SQL)
def q_stream_routes(spark, sf_dir):
    job = SJ.ledger_stream(spark, sf_dir, SJ.new_run(spark, "stream_routes"))
    sent = job.committed_rows(job.routes_root).filter(F.col("route") != "UNROUTED")
    return sent.select("key", "ticket_id", "route", "message")


@register("stream_fallback", FALLBACK_SQL)
def q_stream_fallback(spark, sf_dir):
    run = SJ.new_run(spark, "stream_fallback")
    SJ.contract_stream(spark, sf_dir, run)
    return spark.read.parquet(f"{run.root}/fallback").drop("batch_id")


@register("stream_contract_counts", O.with_base(CONTRACT_COUNTS_SQL["request"], [O.F8_CTE]))
def q_stream_contract_counts(spark, sf_dir):
    run = SJ.new_run(spark, "stream_contract_counts")
    return SJ.checked_stream(spark, sf_dir, run).groupBy("contract", "rule").agg(F.sum("n_rows").alias("n_rows"))


# ---------------------------------------------------------------- rules over the text tables

from ..functions.rules import classify_text_columns  # noqa: E402


def _text_cls_sql(src: str, cols: str, where: str = "") -> str:
    return f"""SELECT {cols}, {O.category_sql('mt')} AS category,
       CASE WHEN {O.category_sql('mt')} = 'SUBSCRIPTION' THEN {O.tier_sql('mt')} END AS target_tier,
       {O.confidence_sql(O.category_sql('mt'))} AS confidence_score
FROM (SELECT *, lower(text) AS mt FROM {src} {where})"""


@register("classify_documents", _text_cls_sql("documents", "doc_id, lang"))
def q_classify_documents(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", *classify_text_columns("text"))


@register("classify_conversations", _text_cls_sql("conversations", "conv_id, turn, role"))
def q_classify_conversations(spark, sf_dir):
    c = FX.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", *classify_text_columns("text"))
