"""Rule tables, domains and text templates.

Everything in the block below is a FIXED VALUE: it must equal the values of
the service this engine re-implements, or classification, gating, savings and
reply texts stop matching.  The values are data; the code that uses them lives
in ``functions/`` and ``operators/``.
"""

from __future__ import annotations

from decimal import Decimal

# --------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour exactly)
# --------------------------------------------------------------------------

# Intent rules, tested in this order; first match wins (substring, lower case).
SUBSCRIPTION_KEYWORDS = ["upgrade", "downgrade", "tier", "subscription", "plan", "switch to"]
BILLING_KEYWORDS = ["balance", "invoice", "invoices", "credit", "how much do we owe", "billing statement"]
TECHNICAL_KEYWORDS = ["bug", "error", "502", "crash", "webhook"]

# Target tier words, tested in this order; default Enterprise.
TIER_WORDS = [
    (["starter"], "Starter"),
    (["professional", "pro"], "Professional"),
    (["enterprise"], "Enterprise"),
]
DEFAULT_TARGET_TIER = "Enterprise"

# Rule confidences.
CONF_TIER_CHANGE_OK = Decimal("0.95")
CONF_TIER_CHANGE_FAILED = Decimal("0.50")
CONF_BILLING = Decimal("0.93")
CONF_FALLBACK = Decimal("0.55")
CONF_MODEL_ALL_OK = Decimal("0.85")
CONF_MODEL_OTHER = Decimal("0.65")

# Gate threshold (strict less-than escalates).
CONFIDENCE_THRESHOLD = Decimal("0.80")

# Tier price list: key, name, monthly cost, max seats, SLA hours.
TIERS = [
    ("STARTER", "Starter", Decimal("49.00"), 20, 24),
    ("PROFESSIONAL", "Professional", Decimal("199.00"), 100, 8),
    ("ENTERPRISE", "Enterprise", Decimal("999.00"), 1000, 1),
]

# Account row used when an account id is not in the account table.
DEFAULT_ACCOUNT = {
    "company_name_prefix": "Enterprise Account ",
    "current_tier": "Professional",
    "balance_usd": Decimal("5000.00"),
    "currency": "USD",
    "overdue_invoices_count": 0,
    "overdue_amount_usd": Decimal("0.00"),
    "credit_limit_usd": Decimal("25000.00"),
    "billing_cycle": "MONTHLY",
    "seats_allocated": 25,
    "status": "ACTIVE",
}

# Savings model.
MANUAL_BENCHMARK_MINUTES = Decimal("15")
SUPPORT_REP_HOURLY_COST = Decimal("25.00")
AI_COST_PER_TICKET = Decimal("0.03")
# (25.00 / 60) * 15 - 0.03
NET_SAVING_PER_RESOLVED = Decimal("6.22")
MANUAL_COST_PER_TICKET = Decimal("6.25")

# Ledger / audit domains and defaults.
TICKET_PRIORITIES = ["LOW", "MEDIUM", "HIGH", "URGENT"]
LEDGER_STATUSES = ["PENDING", "RESOLVED", "ESCALATED", "FAILED"]
RESPONSE_STATUSES = ["RESOLVED", "ESCALATED", "NEEDS_INFO"]
AUDIT_STATUSES = ["SUCCESS", "WARNING", "ERROR", "SKIPPED"]
STORED_OUTCOME_STATUSES = ["RESOLVED", "ESCALATED"]
DEFAULT_CATEGORY = "GENERAL"
DEFAULT_PRIORITY = "MEDIUM"
DEFAULT_STATUS = "PENDING"
DEFAULT_COST_USD = Decimal("0.0300")
LEDGER_LENGTHS = {  # VARCHAR(n) limits of the ledger
    "idempotency_key": 128,
    "ticket_id": 64,
    "customer_id": 64,
    "customer_email": 255,
    "subject": 255,
    "category": 64,
    "priority": 32,
    "status": 32,
}

# Audit step names.
STEP_INGESTION = "TICKET_INGESTION"
STEP_GATE = "CONFIDENCE_GATEKEEPER"
STEP_FALLBACK = "FALLBACK_EXCEPTION_HANDLER"
STEP_IDEMPOTENCY = "IDEMPOTENCY_VERIFICATION"
STEP_INTENT = "LLM_INTENT_AND_TOOL_CALLING"
STEP_WORKFLOW_FAILURE = "N8N_WORKFLOW_FAILURE_ROLLBACK"

# Tool names.
TOOL_BALANCE = "check_account_balance"
TOOL_TIER = "update_subscription_tier"

# Text templates (%s / %d slots are filled by format_string).
TPL_SUB_REASONING = (
    "Customer requested subscription update to %s. "
    "Executed update_subscription_tier with confirmation %s."
)
TPL_SUB_REPLY = (
    "Hello, We have successfully updated your account (%s) "
    "to the %s tier. Your new limits and features are active immediately."
)
TPL_BILL_REASONING = "Customer requested ledger statement. Retrieved balance $%s USD with %d overdue invoices."
TPL_BILL_REPLY = (
    "Hello, Your current account balance is $%s USD. "
    "You currently have %d overdue invoices on record. Let us know if you need PDF receipt copies."
)
TPL_FALLBACK_REASONING = (
    "Intent confidence (%s) is below safe autonomous threshold (%s). "
    "Inquiry involves ambiguous requirements or unhandled edge cases requiring human triage."
)
TPL_FALLBACK_REPLY = (
    "Hello, thank you for reaching out regarding '%s'. "
    "To ensure this is handled with utmost accuracy, your request has been escalated "
    "to our Tier-2 Enterprise Support Specialists (Ticket #%s). "
    "A team member will review your details and respond shortly."
)
TPL_GATE_ESCALATE = "Confidence %s < %s. Auto-escalated to human."
TPL_GATE_RESOLVE = "Confidence %s >= %s. Auto-resolved."
TPL_EXC_REASONING = "System exception encountered during processing: %s. Escalated to Tier-2 Engineering."
TPL_EXC_REPLY = (
    "Hello, thank you for reaching out regarding '%s'. "
    "Your ticket #%s has been routed directly to our Senior Technical Operations team "
    "for personalized review. An engineer will follow up within 2 hours."
)
TPL_TIER_MESSAGE = "Successfully updated account '%s' to %s tier."
TPL_TIER_INVALID = "Invalid tier '%s'. Supported tiers are: STARTER, PROFESSIONAL, ENTERPRISE."
TPL_MISSING_ARGUMENT = "%s() missing %d required positional argument%s: %s"
CACHED_REASONING_PREFIX = "Idempotent cached response: "
MODEL_REASONING = "Processed via live LangChain tool-calling agent."
MODEL_DEFAULT_REPLY = "Your request has been processed."
EXC_ACTION = "GRACEFUL_ESCALATION_TRIGGERED"
UNKNOWN_FAILURE = "Unknown runtime failure"

# Routing outputs.
RESOLUTION_CHANNEL = "#customer-support-resolutions"
RESOLUTION_TITLE = "✅ *Ticket Auto-Resolved* [%s]"
ESCALATION_NAME = "🚨 ESCALATION: %s - %s"
ESCALATION_DESCRIPTION = (
    "### Human Triage Required\n\n**Reasoning:** %s\n**Confidence:** %s (Threshold: 80%%)"
    "\n\n**Customer Response Sent:**\n>%s"
)
ESCALATION_TAGS = ["ai-escalation", "tier-2-review"]
ALERT_CHANNEL = "#devops-support-alerts"
ALERT_TEXT = "🔥 *CRITICAL: n8n Workflow Failure Detected*"
ALERT_TITLE = "Workflow: %s (ID: %s)"
ALERT_AUDIT_STATUS = "Logged to PostgreSQL execution_logs"
CACHED_NOTE = "Served from idempotent storage"

# --------------------------------------------------------------------------
# end of fixed values
# --------------------------------------------------------------------------
