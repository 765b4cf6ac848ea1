"""DuckDB oracle SQL: an independent, plain-SQL statement of every query.

The Spark side is built with the DataFrame API; the oracle side is written
here as SQL text over the same parquet tables (pre-registered views
``events``, ``customer``, ...).  The shared ``WITH`` prefix derives the
fixture feeds (FIXTURES.md) the same way the Spark fixtures do.
"""

from __future__ import annotations

from .. import constants as C
from ..sources.fixtures import LEDGER_CUTOFF, REQUEST_TEMPLATES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def any_kw(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def category_sql(text: str) -> str:
    return (
        f"CASE WHEN {any_kw(text, C.SUBSCRIPTION_KEYWORDS)} THEN 'SUBSCRIPTION' "
        f"WHEN {any_kw(text, C.BILLING_KEYWORDS)} THEN 'BILLING' "
        f"WHEN {any_kw(text, C.TECHNICAL_KEYWORDS)} THEN 'TECHNICAL' ELSE 'GENERAL' END"
    )


def tier_sql(text: str) -> str:
    parts = " ".join(f"WHEN {any_kw(text, words)} THEN {q(name)}" for words, name in C.TIER_WORDS)
    return f"CASE {parts} ELSE {q(C.DEFAULT_TARGET_TIER)} END"


def confidence_sql(category: str) -> str:
    return (
        f"CAST(CASE WHEN {category} = 'SUBSCRIPTION' THEN {C.CONF_TIER_CHANGE_OK} "
        f"WHEN {category} = 'BILLING' THEN {C.CONF_BILLING} ELSE {C.CONF_FALLBACK} END AS DECIMAL(4,3))"
    )


def norm_sql(x: str) -> str:
    return f"upper(regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', ''))"


THR = f"CAST({C.CONFIDENCE_THRESHOLD} AS DECIMAL(4,3))"


def gate_msg_sql(conf: str) -> str:
    return (
        f"CASE WHEN {conf} < {THR} THEN printf({q(C.TPL_GATE_ESCALATE)}, printf('%.3f', {conf}), printf('%.2f', {THR})) "
        f"ELSE printf({q(C.TPL_GATE_RESOLVE)}, printf('%.3f', {conf}), printf('%.2f', {THR})) END"
    )


_TPL_VALUES = ", ".join(f"({i}, {q(s)}, {q(b)})" for i, (s, b) in enumerate(REQUEST_TEMPLATES))
K = "json_extract_string(e.props, '$.k')"

BASE_CTES = {
    "tpl": f"tpl(i, subject, body) AS (VALUES {_TPL_VALUES})",
    "f1": f"""f1 AS (
  SELECT e.event_id,
         'TCK-' || CAST(e.event_id AS VARCHAR) AS ticket_id,
         CASE WHEN e.event_id % 7 = 3 THEN 'GUEST-' || CAST(e.user_id AS VARCHAR)
              WHEN e.event_id % 5 = 0 THEN ' cust-' || CAST(e.user_id AS VARCHAR) || ' '
              ELSE 'CUST-' || CAST(e.user_id AS VARCHAR) END AS customer_id,
         CASE WHEN e.event_id % 4 <> 0 THEN 'user' || CAST(e.user_id AS VARCHAR) || '@example.com' END AS customer_email,
         CASE WHEN e.event_id % 11 = 0 THEN NULL
              WHEN e.event_id % 13 = 0 THEN ''
              ELSE 'IDEMP-' || CAST(e.user_id AS VARCHAR) || '-' || {K} END AS idempotency_key,
         v.subject, v.body, e.ts AS created_at,
         CAST(floor(e.value * 10) AS INTEGER) AS execution_time_ms
  FROM events e JOIN tpl v ON e.event_id % 12 = v.i)""",
    "keyed": "keyed AS (SELECT *, coalesce(nullif(idempotency_key, ''), ticket_id) AS key FROM f1)",
    "firsts": """firsts AS (SELECT * FROM keyed
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at, ticket_id) = 1)""",
    "cls": f"""cls AS (
  SELECT *, {category_sql('mt')} AS category,
         CASE WHEN {category_sql('mt')} = 'SUBSCRIPTION' THEN {tier_sql('mt')} END AS target_tier
  FROM (SELECT *, lower(subject || ' ' || body) AS mt FROM firsts))""",
    "decided": f"""decided AS (
  SELECT *, {confidence_sql('category')} AS confidence_score FROM cls)""",
    "gated": f"""gated AS (
  SELECT *, CASE WHEN confidence_score < {THR} THEN 'ESCALATED' ELSE 'RESOLVED' END AS status,
         CASE WHEN confidence_score < {THR} THEN 'WARNING' ELSE 'SUCCESS' END AS gate_status,
         {gate_msg_sql('confidence_score')} AS gate_message
  FROM decided)""",
    "accts": f"""accts AS (
  SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) AS account_id, c_name AS company_name,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'Starter' ELSE 'Enterprise' END AS current_tier,
         CAST(c_acctbal AS DECIMAL(18,2)) AS balance_usd, 'USD' AS currency,
         CAST(c_custkey % 3 AS INTEGER) AS overdue_invoices_count,
         CAST((c_custkey % 3) * 250 AS DECIMAL(18,2)) AS overdue_amount_usd,
         CAST(10000 + (c_custkey % 5) * 10000 AS DECIMAL(18,2)) AS credit_limit_usd,
         CASE WHEN c_custkey % 2 = 0 THEN 'ANNUAL' ELSE 'MONTHLY' END AS billing_cycle,
         CAST(10 + c_custkey % 90 AS INTEGER) AS seats_allocated,
         CASE WHEN c_acctbal < 0 THEN 'OVERDUE_WARNING' ELSE 'ACTIVE' END AS status
  FROM customer)""",
    "tiers": "tiers(tier_key, name, monthly_cost, max_seats, sla_hours) AS (VALUES "
    + ", ".join(f"({q(k)}, {q(n)}, CAST({c} AS DECIMAL(10,2)), {m}, {s})" for k, n, c, m, s in C.TIERS)
    + ")",
}


def with_base(body: str, extra: list[str] | None = None) -> str:
    ctes = list(BASE_CTES.values()) + list(extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


LEDGER_CUTOFF_SQL = f"TIMESTAMP '{LEDGER_CUTOFF}'"


def fixed_sql(x: str, d: int) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,{d})) AS VARCHAR)"


_D = C.DEFAULT_ACCOUNT


def _acct(col: str, default_sql: str) -> str:
    return f"CASE WHEN a.account_id IS NOT NULL THEN a.{col} ELSE {default_sql} END AS acct_{col}"


ACCOUNT_DEFAULTS_SQL = {
    "company_name": f"{q(_D['company_name_prefix'])} || {{id}}",
    "current_tier": q(_D["current_tier"]),
    "balance_usd": f"CAST({_D['balance_usd']} AS DECIMAL(18,2))",
    "currency": q(_D["currency"]),
    "overdue_invoices_count": f"CAST({_D['overdue_invoices_count']} AS INTEGER)",
    "overdue_amount_usd": f"CAST({_D['overdue_amount_usd']} AS DECIMAL(18,2))",
    "credit_limit_usd": f"CAST({_D['credit_limit_usd']} AS DECIMAL(18,2))",
    "billing_cycle": q(_D["billing_cycle"]),
    "seats_allocated": f"CAST({_D['seats_allocated']} AS INTEGER)",
    "status": q(_D["status"]),
}


def lookup_sql(src: str, accts: str = "accts") -> str:
    """Left join of ``src`` (with customer_id) to an account table + default row."""
    cols = ",\n         ".join(_acct(c, d.replace("{id}", "r0.account_id")) for c, d in ACCOUNT_DEFAULTS_SQL.items())
    return f"""SELECT r0.*, a.account_id IS NOT NULL AS account_found,
         {cols}
  FROM (SELECT s.*, {norm_sql('s.customer_id')} AS account_id FROM {src} s) r0
  LEFT JOIN {accts} a ON a.account_id = r0.account_id"""


BAL_RESULT_JSON = """json_object('success', true, 'account_id', account_id, 'company_name', acct_company_name,
  'balance_usd', CAST(acct_balance_usd AS DOUBLE), 'currency', acct_currency,
  'overdue_invoices_count', acct_overdue_invoices_count, 'overdue_amount_usd', CAST(acct_overdue_amount_usd AS DOUBLE),
  'credit_limit_usd', CAST(acct_credit_limit_usd AS DOUBLE), 'status', acct_status,
  'timestamp', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'))"""

TIER_RESULT_JSON = f"""json_object('success', true, 'account_id', account_id, 'previous_tier', previous_tier,
  'new_tier', tier_name, 'monthly_cost_usd', CAST(monthly_cost AS DOUBLE), 'max_seats', max_seats,
  'effective_date', strftime(created_at, '%Y-%m-%d'), 'confirmation_id', confirmation_id,
  'message', printf({q(C.TPL_TIER_MESSAGE)}, account_id, tier_name))"""

TIER_FAILURE_JSON = "json_object('success', false, 'error', 'Invalid tier ''" + "' || target_tier || '" + "''. Supported tiers are: STARTER, PROFESSIONAL, ENTERPRISE.')"


def res_chain(p: str = "", src: str = "decided", accts: str = "accts") -> list[str]:
    return [
    f"{p}r1 AS ({lookup_sql(src, accts)})",
    f"""{p}r2 AS (SELECT r1.*, t.tier_key IS NOT NULL AS tier_valid, t.name AS tier_name, t.monthly_cost, t.max_seats,
         (r1.category = 'SUBSCRIPTION' AND t.tier_key IS NOT NULL) AS is_change
  FROM {p}r1 r1 LEFT JOIN tiers t ON t.tier_key = {norm_sql('r1.target_tier')})""",
    f"""{p}r3 AS (SELECT r2.*,
         coalesce(last_value(CASE WHEN is_change THEN tier_name END IGNORE NULLS) OVER w_prev, acct_current_tier) AS previous_tier,
         greatest(acct_seats_allocated, max(CASE WHEN is_change THEN max_seats // 2 END) OVER w_run) AS seats_after,
         CASE WHEN is_change THEN 'TIER-CHG-' || CAST(CAST(floor(epoch(created_at)) AS BIGINT) AS VARCHAR) ELSE 'N/A' END AS confirmation_id
  FROM {p}r2 r2
  WINDOW w_prev AS (PARTITION BY account_id ORDER BY created_at, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w_run AS (PARTITION BY account_id ORDER BY created_at, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    f"""{p}r4 AS (SELECT r3.*,
         CASE WHEN confidence_score < {THR} THEN 'ESCALATED' ELSE 'RESOLVED' END AS status,
         CASE WHEN confidence_score < {THR} THEN 'WARNING' ELSE 'SUCCESS' END AS gate_status,
         {gate_msg_sql('confidence_score')} AS gate_message,
         CASE WHEN category = 'SUBSCRIPTION' THEN printf({q(C.TPL_SUB_REASONING)}, target_tier, confirmation_id)
              WHEN category = 'BILLING' THEN printf({q(C.TPL_BILL_REASONING)}, {fixed_sql('acct_balance_usd', 2)}, acct_overdue_invoices_count)
              ELSE printf({q(C.TPL_FALLBACK_REASONING)}, {fixed_sql('confidence_score', 2)}, {fixed_sql(THR, 2)}) END AS reasoning0,
         CASE WHEN category = 'SUBSCRIPTION' THEN printf({q(C.TPL_SUB_REPLY)}, customer_id, target_tier)
              WHEN category = 'BILLING' THEN printf({q(C.TPL_BILL_REPLY)}, format('{{:,.2f}}', CAST(acct_balance_usd AS DOUBLE)), acct_overdue_invoices_count)
              ELSE printf({q(C.TPL_FALLBACK_REPLY)}, subject, ticket_id) END AS customer_reply,
         CASE WHEN category = 'SUBSCRIPTION' THEN {q(C.TOOL_TIER)} WHEN category = 'BILLING' THEN {q(C.TOOL_BALANCE)} END AS tool_name
  FROM {p}r3 r3)""",
    f"""{p}res AS (SELECT r4.* EXCLUDE (reasoning0, status, gate_status, gate_message), status, gate_status, gate_message,
         reasoning0 || ' [' || gate_message || ']' AS reasoning,
         CASE WHEN tool_name = {q(C.TOOL_TIER)} THEN json_object('account_id', customer_id, 'new_tier', target_tier)
              WHEN tool_name IS NOT NULL THEN json_object('account_id', customer_id) END AS parameters_json,
         CASE WHEN tool_name = {q(C.TOOL_TIER)} THEN CASE WHEN tier_valid THEN {TIER_RESULT_JSON} ELSE {TIER_FAILURE_JSON} END
              WHEN tool_name = {q(C.TOOL_BALANCE)} THEN {BAL_RESULT_JSON} END AS result_json,
         CASE WHEN tool_name = {q(C.TOOL_TIER)} THEN tier_valid WHEN tool_name IS NOT NULL THEN true END AS tool_success,
         CASE WHEN tool_name = {q(C.TOOL_TIER)} AND NOT tier_valid THEN printf({q(C.TPL_TIER_INVALID)}, target_tier) END AS tool_error
  FROM {p}r4 r4)""",
    ]




RES_CTES = res_chain()


def with_res(body: str, extra: list[str] | None = None) -> str:
    return with_base(body, RES_CTES + list(extra or []))


def decided_chain(p: str, firsts: str) -> list[str]:
    """Classification + rule confidence over another first-per-key table."""
    return [
        f"""{p}cls AS (
  SELECT *, {category_sql('mt')} AS category,
         CASE WHEN {category_sql('mt')} = 'SUBSCRIPTION' THEN {tier_sql('mt')} END AS target_tier
  FROM (SELECT *, lower(subject || ' ' || body) AS mt FROM {firsts}))""",
        f"{p}decided AS (SELECT *, {confidence_sql('category')} AS confidence_score FROM {p}cls)",
    ]


ACTIONS_JSON_SQL = """CASE WHEN tool_name IS NULL THEN '[]' ELSE
  '[{"tool_name":' || to_json(tool_name) || ',"parameters":' || CAST(parameters_json AS VARCHAR)
  || ',"result":' || coalesce(CAST(result_json AS VARCHAR), '{}') || ',"success":'
  || CASE WHEN tool_success THEN 'true' ELSE 'false' END || ',"error":' || coalesce(CAST(to_json(tool_error) AS VARCHAR), 'null') || '}]' END"""


def ledger_rows_sql(src: str, status: str = "status") -> str:
    return f"""SELECT sha256(key) AS ticket_key, key AS idempotency_key, ticket_id, customer_id,
       customer_email, subject, body, category, {q(C.DEFAULT_PRIORITY)} AS priority,
       {status} AS status, CAST(confidence_score AS DECIMAL(4,3)) AS confidence_score,
       reasoning AS resolution_summary, customer_reply, {ACTIONS_JSON_SQL} AS actions_taken,
       execution_time_ms, CAST({C.DEFAULT_COST_USD} AS DECIMAL(6,4)) AS cost_estimate_usd,
       created_at, created_at AS updated_at
FROM {src}"""


ACCT_FIELDS = ["company_name", "current_tier", "balance_usd", "currency", "overdue_invoices_count",
               "overdue_amount_usd", "credit_limit_usd", "billing_cycle", "seats_allocated", "status"]


def account_state_sql(accts: str, calls: str) -> str:
    """Accounts after the tool calls in ``calls`` (account_id, created_at, ticket_id, is_change, tier_name, max_seats)."""
    known = "a.account_id IS NOT NULL"
    cols = []
    for c in ACCT_FIELDS:
        d = ACCOUNT_DEFAULTS_SQL[c].replace("{id}", "t.account_id")
        base = f"CASE WHEN {known} THEN a.{c} ELSE {d} END"
        if c == "current_tier":
            base = f"coalesce(t.last_tier, {base})"
        if c == "seats_allocated":
            base = f"greatest({base}, t.max_half)"
        cols.append(f"{base} AS {c}")
    return f"""SELECT coalesce(a.account_id, t.account_id) AS account_id, {', '.join(cols)},
       CAST(coalesce(t.tier_changes, 0) AS BIGINT) AS tier_changes, CAST(coalesce(t.tool_calls, 0) AS BIGINT) AS tool_calls,
       a.account_id IS NULL AS is_new
FROM {accts} a FULL OUTER JOIN (
  SELECT account_id, arg_max(tier_name, (created_at, ticket_id)) FILTER (WHERE is_change) AS last_tier,
         max(CASE WHEN is_change THEN max_seats // 2 END) AS max_half,
         count(*) FILTER (WHERE is_change) AS tier_changes, count(*) AS tool_calls
  FROM {calls} GROUP BY account_id) t ON a.account_id = t.account_id"""


CUT = f"CAST({q(LEDGER_CUTOFF)} AS TIMESTAMP)"
READABLE = "(" + ", ".join(q(x) for x in C.STORED_OUTCOME_STATUSES) + ")"

LEDGER_CTES = (
    [
        f"pre_firsts AS (SELECT * FROM keyed WHERE created_at < {CUT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at, ticket_id) = 1)",
    ]
    + decided_chain("p_", "pre_firsts")
    + res_chain("p_", "p_decided", "accts")
    + [
        f"""seed AS ({ledger_rows_sql('p_res', "CASE WHEN event_id % 17 = 0 THEN 'PENDING' WHEN event_id % 19 = 0 THEN 'FAILED' ELSE status END")})""",
        f"""state AS ({account_state_sql('accts', "(SELECT account_id, created_at, ticket_id, is_change, tier_name, max_seats FROM p_res WHERE category = 'BILLING' OR is_change)")})""",
        f"inc AS (SELECT * FROM keyed WHERE created_at >= {CUT})",
        f"""hits AS (SELECT i.*, s.ticket_id AS stored_ticket_id, s.status AS stored_status, s.confidence_score AS stored_confidence_score,
       s.category AS stored_category, s.resolution_summary AS stored_resolution_summary,
       s.customer_reply AS stored_customer_reply, s.execution_time_ms AS stored_execution_time_ms,
       s.actions_taken AS stored_actions_taken
  FROM inc i JOIN seed s ON s.idempotency_key = i.key WHERE s.status IN {READABLE})""",
        f"""new_firsts AS (SELECT * FROM inc WHERE key NOT IN (SELECT idempotency_key FROM seed WHERE status IN {READABLE})
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at, ticket_id) = 1)""",
    ]
    + decided_chain("n_", "new_firsts")
    + res_chain("n_", "n_decided", "state")
    + [
        f"batch AS ({ledger_rows_sql('n_res')})",
        """upserted AS (SELECT coalesce(l.idempotency_key, b.idempotency_key) AS idempotency_key,
       """
        + ",\n       ".join(
            (
                f"CASE WHEN b.idempotency_key IS NOT NULL THEN b.{c} ELSE l.{c} END AS {c}"
                if c in ("status", "confidence_score", "resolution_summary", "customer_reply", "actions_taken", "execution_time_ms", "updated_at")
                else f"CASE WHEN l.idempotency_key IS NOT NULL THEN l.{c} ELSE b.{c} END AS {c}"
            )
            for c in ["ticket_key", "ticket_id", "customer_id", "customer_email", "subject", "body", "category", "priority",
                      "status", "confidence_score", "resolution_summary", "customer_reply", "actions_taken",
                      "execution_time_ms", "cost_estimate_usd", "created_at", "updated_at"]
        )
        + """,
       CASE WHEN l.idempotency_key IS NULL THEN 'INSERTED' WHEN b.idempotency_key IS NOT NULL THEN 'UPDATED' ELSE 'KEPT' END AS change
  FROM seed l FULL OUTER JOIN batch b ON l.idempotency_key = b.idempotency_key)""",
    ]
)


def with_ledger(body: str, extra: list[str] | None = None) -> str:
    return with_base(body, LEDGER_CTES + list(extra or []))


F12_CTE = """f12 AS (
  SELECT event_id, created_at, epoch_ns(date_trunc('second', created_at)) // 1000000000 // 345600
         + CASE WHEN event_id % 19 = 0 THEN 1 WHEN event_id % 31 = 0 THEN 3 ELSE 0 END + late AS slot
  FROM f1, (VALUES (1, 0), (7, 0), (5, 1), (3, 3)) c(n, late) WHERE event_id % n = 0)"""

#: A copy is late if its time is at or before the watermark: the largest time of all earlier slots in whole milliseconds, less two days.
REDELIVERIES_SQL = """SELECT event_id, CASE WHEN bool_or(w.mark IS NULL OR created_at > w.mark) THEN 'PASSED' ELSE 'LATE' END AS outcome, count(*) AS n_copies
FROM f12 JOIN (SELECT a.slot, date_trunc('milliseconds', max(b.latest)) - INTERVAL 2 DAYS AS mark
               FROM (SELECT DISTINCT slot FROM f12) a LEFT JOIN (SELECT slot, max(created_at) AS latest FROM f12 GROUP BY slot) b ON b.slot < a.slot GROUP BY a.slot) w USING (slot)
GROUP BY event_id"""

F8_CTE = """f8 AS (
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE ticket_id END AS ticket_id, customer_id, idempotency_key,
         CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 37 = 0 THEN repeat('x', 256) ELSE subject END AS subject,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE body END AS body, created_at, execution_time_ms,
         CASE WHEN event_id % 41 = 0 THEN 'NOW' ELSE 'MEDIUM' END AS priority,
         CAST(CASE WHEN event_id % 43 = 0 THEN 12.5 ELSE 0.9 END AS DECIMAL(10,3)) AS confidence_raw
  FROM f1)"""

F6_CTE = f"""f6 AS (
  SELECT event_id,
         CASE WHEN event_id % 7 = 0 THEN '{{"category":"BILLING","confidence'
              ELSE '{{"category":"BILLING","confidence_score":' || CASE WHEN event_id % 5 = 0 THEN '1.5' ELSE '0.9' END
                   || ',"requires_escalation":false,"reasoning":"r' || {K} || '"'
                   || CASE WHEN event_id % 3 = 0 THEN '}}' ELSE ',"customer_reply":"ok"}}' END END AS output_json,
         CASE WHEN event_id % 4 = 0 THEN '{{"content":"done","tool_calls":[]}}'
              WHEN event_id % 4 = 1 THEN '{{"content":"done","tool_calls":[{{"name":"wipe_disk","args":{{}}}}]}}'
              ELSE '{{"content":"done","tool_calls":[{{"name":"check_account_balance","args":{{"account_id":"CUST-'
                   || CAST(user_id AS VARCHAR) || '"}}}}]}}' END AS message_json
  FROM events e)"""

F5_CTE = f"""f5 AS (
  SELECT event_id,
         CASE WHEN event_id % 4 = 0 THEN '[{{"tool":"check_account_balance","status":"SUCCESS","details":{{"n":' || {K} || '}}}}]'
              WHEN event_id % 4 = 1 THEN '[{{"tool_name":"update_subscription_tier","parameters":{{"n":' || {K} || '}},"success":false,"error":"E' || {K} || '"}},{{"tool":"check_account_balance","status":"SUCCESS"}}]'
              WHEN event_id % 20 = 2 THEN '[{{"tool":"check_account_balance","status":"FAILED"}},{{"success":true}},{{"tool_name":"x","result":{{"r":1}}}}]'
              WHEN event_id % 4 = 2 THEN '[{{"tool":"check_account_balance","status":"FAILED"}}]'
              ELSE '[]' END AS actions_json
  FROM events e)"""

F7_CTE = f"""f7 AS (
  SELECT '{{"execution":{{"id":"' || CAST(event_id AS VARCHAR) || '"'
         || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"error":{{"message":"m' || {K} || '","stack":"s"}}' END
         || '}},"workflow":{{"name":"wf-' || CAST(user_id % 4 AS VARCHAR) || '"}}}}' AS failure_json, ts AS failed_at
  FROM events e WHERE event_type = 'error')"""

FAILURES_CTE = f"""failures AS (
  SELECT json_extract_string(failure_json, '$.execution.id') AS execution_id,
         json_extract_string(failure_json, '$.workflow.name') AS workflow_name,
         CASE WHEN json_extract(failure_json, '$.execution.error') IS NOT NULL
              THEN json_extract_string(failure_json, '$.execution.error.message') ELSE {q(C.UNKNOWN_FAILURE)} END AS error_message,
         CASE WHEN json_extract(failure_json, '$.execution.error') IS NOT NULL
              THEN json_extract_string(failure_json, '$.execution.error.stack') ELSE '' END AS error_stack,
         failed_at, {q(C.STEP_WORKFLOW_FAILURE)} AS step_name
  FROM f7)"""


F10_CTE = """f10 AS (
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 37 = 0 THEN repeat('s', 65) ELSE 'TICKET_INGESTION' END AS step_name,
         CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'DONE' ELSE 'SUCCESS' END AS status,
         CAST(CASE WHEN event_id % 41 = 0 THEN -5 WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 400 END AS INTEGER) AS latency_ms,
         CASE WHEN event_id % 43 = 0 THEN 1.5 ELSE 0.9 END AS confidence_score,
         CASE WHEN event_id % 7 <> 0 AND event_id % 3 <> 0 THEN '{"ticket_id":"TCK-' || CAST(event_id AS VARCHAR) || '"}' END AS input_payload
  FROM events)"""

F11_CTE = """f11 AS (
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 1.5 WHEN event_id % 29 = 0 THEN -0.1 WHEN event_id % 13 = 0 THEN NULL ELSE 0.9 END AS confidence_score,
         CASE WHEN event_id % 31 = 0 THEN 'PENDING' WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'NEEDS_INFO' ELSE 'RESOLVED' END AS status,
         CASE WHEN event_id % 47 = 0 OR event_id % 4 = 0 THEN 0 WHEN event_id % 41 = 0 THEN 1 WHEN event_id % 6 = 1 THEN 1 ELSE 0 END AS incomplete
  FROM events)"""


def counts_sql(contract: str, src: str, rules: list[tuple[str, str]]) -> str:
    """One row for each rule of a contract, and two for all and all broken rows."""
    each = [("rows", "true"), ("broken", " OR ".join(f"coalesce({p}, false)" for _, p in rules)), *rules]
    return "\nUNION ALL\n".join(f"SELECT {q(contract)} AS contract, {q(c)} AS rule, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) AS n_rows FROM {src}" for c, p in each)


def violations_sql(rules: list[tuple[str, str]]) -> str:
    """violation_text and n_violations columns from (code, SQL predicate) pairs."""
    text = "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN {q(c)} END" for c, p in rules) + ")"
    n = "CAST(" + " + ".join(f"(CASE WHEN {p} THEN 1 ELSE 0 END)" for c, p in rules) + " AS INTEGER)"
    return f"{text} AS violation_text, {n} AS n_violations"


REQUEST_RULES_SQL = [
    ("TICKET_ID_REQUIRED", "ticket_id IS NULL"),
    ("CUSTOMER_ID_REQUIRED", "customer_id IS NULL"),
    ("SUBJECT_REQUIRED", "subject IS NULL"),
    ("SUBJECT_EMPTY", "subject IS NOT NULL AND length(subject) < 1"),
    ("BODY_REQUIRED", "body IS NULL"),
    ("BODY_EMPTY", "body IS NOT NULL AND length(body) < 1"),
]


def ledger_rules_sql() -> list[tuple[str, str]]:
    pr = ", ".join(q(x) for x in C.TICKET_PRIORITIES)
    st = ", ".join(q(x) for x in C.LEDGER_STATUSES)
    rules = [
        ("KEY_REQUIRED", "idempotency_key IS NULL"),
        ("TICKET_ID_REQUIRED", "ticket_id IS NULL"),
        ("CUSTOMER_ID_REQUIRED", "customer_id IS NULL"),
        ("SUBJECT_REQUIRED", "subject IS NULL"),
        ("BODY_REQUIRED", "body IS NULL"),
        ("STATUS_REQUIRED", "status IS NULL"),
        ("PRIORITY_DOMAIN", f"priority IS NOT NULL AND priority NOT IN ({pr})"),
        ("STATUS_DOMAIN", f"status IS NOT NULL AND status NOT IN ({st})"),
    ]
    for c, n in C.LEDGER_LENGTHS.items():
        rules.append((f"{c.upper()}_TOO_LONG", f"length({c}) > {n}"))
    rules.append(("CONFIDENCE_OVERFLOW", "confidence_raw IS NOT NULL AND TRY_CAST(confidence_raw AS DECIMAL(4,3)) IS NULL"))
    return rules


AUDIT_RULES_SQL = [
    ("STEP_REQUIRED", "step_name IS NULL"),
    ("STATUS_REQUIRED", "status IS NULL"),
    ("STATUS_DOMAIN", "status IS NOT NULL AND status NOT IN (" + ", ".join(q(x) for x in C.AUDIT_STATUSES) + ")"),
    ("STEP_TOO_LONG", "length(step_name) > 64"),
    ("LATENCY_NEGATIVE", "latency_ms < 0"),
    ("CONFIDENCE_RANGE", "confidence_score < 0 OR confidence_score > 1"),
]


RESPONSE_RULES_SQL = [
    ("CONFIDENCE_RANGE", "confidence_score < 0 OR confidence_score > 1"),
    ("STATUS_DOMAIN", "NOT coalesce(status IN ('RESOLVED', 'ESCALATED', 'NEEDS_INFO'), false)"),
    ("ACTION_INCOMPLETE", "incomplete > 0"),
]


# ------------------------------------------------------------------ cached actions, asked tiers, model path, feed files


def _cached_action(a: str) -> str:
    part = lambda *paths: "coalesce(" + ", ".join(f"CAST(json_extract({a}, '$.{p}') AS VARCHAR)" for p in paths) + ", '{}')"
    return (
        f"""'{{"tool_name":' || to_json(coalesce(json_extract_string({a}, '$.tool'), json_extract_string({a}, '$.tool_name'), 'unknown'))"""
        f""" || ',"parameters":' || {part("parameters")} || ',"result":' || {part("details", "result")} || ',"success":'"""
        f""" || CASE WHEN coalesce(json_extract_string({a}, '$.status') = 'SUCCESS', false) OR coalesce(CAST(json_extract({a}, '$.success') AS BOOLEAN), true) THEN 'true' ELSE 'false' END"""
        f""" || ',"error":' || coalesce(CAST(to_json(json_extract_string({a}, '$.error')) AS VARCHAR), 'null') || '}}'"""
    )


CACHED_ACTIONS_SQL = f"'[' || coalesce(array_to_string([{_cached_action('a')} FOR a IN CAST(json_extract(stored_actions_taken, '$[*]') AS JSON[])], ','), '') || ']'"

_ASKED = "CASE WHEN event_id % 10 = 0 THEN 'Gold' WHEN event_id % 10 < 4 THEN ' starter ' WHEN event_id % 10 < 7 THEN 'Professional' ELSE 'enterprise' END"

ASKED_TIER_CTES = [
    f"""q_decided AS (SELECT * REPLACE (CASE WHEN category = 'SUBSCRIPTION' THEN {_ASKED} END AS target_tier,
         CAST(CASE WHEN category = 'SUBSCRIPTION' AND event_id % 10 = 0 THEN 0.50 ELSE confidence_score END AS DECIMAL(4,3)) AS confidence_score) FROM decided)""",
    *res_chain("q_", "q_decided"),
]

FAILED_TIER_SQL = f"""SELECT key, target_tier, tier_valid, confidence_score, status, CASE WHEN tier_valid THEN previous_tier END AS previous_tier,
       CASE WHEN tier_valid THEN seats_after END AS seats_after, reasoning, customer_reply, {ACTIONS_JSON_SQL} AS actions_taken, CASE WHEN confidence_score < {THR} THEN 'WARNING' ELSE 'SUCCESS' END AS audit_status,
       json_object('status', status, 'gate_decision', gate_message)::VARCHAR AS output_payload
FROM q_res WHERE category = 'SUBSCRIPTION'"""


def _call_text(name: str, *args: str) -> str:
    return " || ".join([f"""'{{"name":"{name}","args":{{'""", *args, "'}}'"])


_ACCOUNT_ARG = """'"account_id":"' || customer_id || '"'"""
_BALANCE, _UNKNOWN = _call_text("check_account_balance", _ACCOUNT_ARG), """'{"name":"wipe_disk","args":{}}'"""


def _tier_call(t: str) -> str:
    return _call_text("update_subscription_tier", _ACCOUNT_ARG, """',"new_tier":"'""", t, """'"'""")


def _message(content: str, *calls: str) -> str:
    return f"""'{{"content":{content},"tool_calls":[' || """ + " || ',' || ".join(calls or ["''"]) + " || ']}'"


_MESSAGES = [
    _message('"done"'),
    _message('"done"', _UNKNOWN),
    _message('"done"', _BALANCE),
    _message('"done"', _tier_call(_ASKED)),
    _message('""', _tier_call("'Starter'"), _BALANCE, _tier_call("'Enterprise'")),
    _message('"done"', _call_text("check_account_balance")),
    _message('"done"', _call_text("update_subscription_tier", _ACCOUNT_ARG), _BALANCE, _call_text("update_subscription_tier")),
    _message("null", _UNKNOWN, _tier_call("' professional '")),
]
_WINDOW = "PARTITION BY account_id ORDER BY created_at, ticket_id, call_no ROWS BETWEEN UNBOUNDED PRECEDING AND"

MODEL_PATH_CTES = [
    "f9 AS (SELECT *, CASE " + " ".join(f"WHEN event_id % 8 = {i} THEN {m}" for i, m in enumerate(_MESSAGES)) + " END AS message_json FROM keyed)",
    "m_firsts AS (SELECT * FROM f9 QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at, ticket_id) = 1)",
    """m_calls AS (SELECT key, created_at, ticket_id, call_no, json_extract(message_json, '$.tool_calls[' || call_no || ']') AS c
  FROM m_firsts, unnest(range(CAST(json_array_length(message_json, '$.tool_calls') AS BIGINT))) r(call_no))""",
    """m_known AS (SELECT key, created_at, ticket_id, call_no, c, json_extract_string(c, '$.name') AS tool_name,
         json_extract_string(c, '$.args.account_id') AS customer_id, json_extract_string(c, '$.args.new_tier') AS target_tier
  FROM m_calls WHERE json_extract_string(c, '$.name') IN ('check_account_balance', 'update_subscription_tier'))""",
    f"m1 AS ({lookup_sql('m_known')})",
    f"""m2 AS (SELECT m1.*, t.name AS tier_name, t.monthly_cost, t.max_seats, t.tier_key IS NOT NULL AS tier_valid,
         CASE WHEN tool_name = 'check_account_balance' AND customer_id IS NULL THEN 'check_account_balance() missing 1 required positional argument: ''account_id'''
              WHEN tool_name = 'update_subscription_tier' AND customer_id IS NULL AND target_tier IS NULL THEN 'update_subscription_tier() missing 2 required positional arguments: ''account_id'' and ''new_tier'''
              WHEN tool_name = 'update_subscription_tier' AND customer_id IS NULL THEN 'update_subscription_tier() missing 1 required positional argument: ''account_id'''
              WHEN tool_name = 'update_subscription_tier' AND target_tier IS NULL THEN 'update_subscription_tier() missing 1 required positional argument: ''new_tier''' END AS error
  FROM m1 LEFT JOIN tiers t ON t.tier_key = {norm_sql('m1.target_tier')})""",
    "m3 AS (SELECT *, coalesce(error IS NULL AND tool_name = 'update_subscription_tier' AND tier_valid, false) AS is_change FROM m2)",
    f"""m4 AS (SELECT *, coalesce(last_value(CASE WHEN is_change THEN tier_name END IGNORE NULLS) OVER ({_WINDOW} 1 PRECEDING), acct_current_tier) AS previous_tier,
         'TIER-CHG-' || CAST(CAST(floor(epoch(created_at)) AS BIGINT) AS VARCHAR) AS confirmation_id FROM m3)""",
    f"""m5 AS (SELECT *, CASE WHEN error IS NOT NULL THEN '{{}}' WHEN tool_name = 'check_account_balance' THEN CAST({BAL_RESULT_JSON} AS VARCHAR)
         WHEN tier_valid THEN CAST({TIER_RESULT_JSON} AS VARCHAR) ELSE CAST({TIER_FAILURE_JSON} AS VARCHAR) END AS result FROM m4)""",
    """m6 AS (SELECT key, bool_and(error IS NULL) AS all_ok, string_agg('{"tool_name":' || to_json(tool_name) || ',"parameters":' || CAST(json_extract(c, '$.args') AS VARCHAR)
         || ',"result":' || result || ',"success":' || CASE WHEN error IS NULL THEN 'true' ELSE 'false' END || ',"error":' || coalesce(CAST(to_json(error) AS VARCHAR), 'null') || '}', ',' ORDER BY call_no) AS actions
  FROM m5 GROUP BY key)""",
    "m7 AS (SELECT f.*, actions, CAST(CASE WHEN all_ok THEN 0.85 ELSE 0.65 END AS DECIMAL(4,3)) AS confidence_score FROM m_firsts f LEFT JOIN m6 USING (key))",
    f"""model_rows AS (SELECT sha256(key) AS ticket_key, key AS idempotency_key, ticket_id, customer_id, customer_email, subject, body, 'GENERAL' AS category, {q(C.DEFAULT_PRIORITY)} AS priority,
       CASE WHEN confidence_score < {THR} THEN 'ESCALATED' ELSE 'RESOLVED' END AS status, confidence_score, {q(C.MODEL_REASONING)} || ' [' || {gate_msg_sql('confidence_score')} || ']' AS resolution_summary,
       coalesce(nullif(json_extract_string(message_json, '$.content'), ''), {q(C.MODEL_DEFAULT_REPLY)}) AS customer_reply, '[' || coalesce(actions, '') || ']' AS actions_taken,
       execution_time_ms, CAST({C.DEFAULT_COST_USD} AS DECIMAL(6,4)) AS cost_estimate_usd, created_at, created_at AS updated_at FROM m7)""",
]

MODEL_STATE_SQL = "SELECT account_id, company_name, current_tier, seats_allocated, tier_changes, tool_calls, is_new FROM (" + account_state_sql(
    "accts",
    "(SELECT account_id, created_at, ticket_id || '/' || CAST(call_no AS VARCHAR) AS ticket_id, is_change, tier_name, max_seats FROM m5 WHERE is_change OR (error IS NULL AND tool_name = 'check_account_balance'))",
) + ")"

FEED_SQL = """SELECT CASE WHEN event_id % 47 <> 0 THEN ticket_id END AS ticket_id, CASE WHEN event_id % 47 <> 0 THEN customer_id END AS customer_id,
       CASE WHEN event_id % 47 <> 0 THEN customer_email END AS customer_email, CASE WHEN event_id % 47 <> 0 THEN subject END AS subject,
       CASE WHEN event_id % 47 <> 0 THEN idempotency_key END AS idempotency_key,
       CASE WHEN event_id % 47 <> 0 AND event_id % 53 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'email' ELSE 'portal' END END AS channel,
       CASE WHEN event_id % 47 <> 0 AND event_id % 53 <> 0 THEN CAST(event_id AS VARCHAR) END AS event,
       CASE WHEN event_id % 47 <> 0 THEN created_at END AS created_at, event_id % 47 = 0 OR event_id % 53 = 0 AS is_corrupt,
       CASE WHEN event_id % 47 = 0 OR event_id % 53 = 0 THEN md5(line) END AS corrupt_md5
FROM (SELECT *, CASE WHEN event_id % 47 = 0 THEN 'x' ELSE '' END || '{"ticket_id":' || to_json(ticket_id) || ',"customer_id":' || to_json(customer_id)
       || CASE WHEN customer_email IS NULL THEN '' ELSE ',"customer_email":' || to_json(customer_email) END || ',"subject":' || to_json(subject) || ',"body":' || to_json(body)
       || CASE WHEN idempotency_key IS NULL THEN '' ELSE ',"idempotency_key":' || to_json(idempotency_key) END
       || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '","metadata":'
       || CASE WHEN event_id % 47 <> 0 AND event_id % 53 = 0 THEN '"none"' ELSE '{"channel":"' || CASE WHEN event_id % 3 = 0 THEN 'email' ELSE 'portal' END || '","event":"' || CAST(event_id AS VARCHAR) || '"}' END || '}' AS line FROM f1)"""
