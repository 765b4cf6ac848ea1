"""Ticket-shaped inputs derived from the driver tables (FIXTURES.md F1-F8 and F10-F12).

The driver tables hold no support tickets, so each feed is a projection of a
driver table (``events`` or ``customer``).  Every function is a narrow
``select`` over its source: no join, no shuffle, so the work grows with the
source and stays inside one whole-stage-codegen span.  The small template
table of F1 is a literal array indexed per row instead of a join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import epoch_seconds

# --------------------------------------------------------------------------
# FIXED VALUES: the twelve request templates of fixture F1 (subject, body)
# --------------------------------------------------------------------------
REQUEST_TEMPLATES = [
    ("Move us up to Enterprise", "We want to upgrade before the quarter closes."),
    ("Ledger question", "Kindly send the balance on file for our org."),
    ("Odd behaviour", "The screen looks off and we might want money back."),
    ("Nightly sync fails", "A 502 comes back whenever the webhook fires."),
    ("Seat change", "Switch to Professional from Starter for the whole office."),
    ("Prorated line disputed", "That invoice lists seats we removed."),
    ("Sign-on help", "Can you share an explanation of single sign-on?"),
    ("Spending cut", "There is a problem with cost so downgrade us."),
    ("Setup seems wrong", "Things look broken, maybe refund the last invoice?"),
    ("Need a hand", "Could somebody call me back."),
    ("Renewal", "Which subscription do we hold today?"),
    ("SWITCH TO STARTER", "now"),
]
# Split point of fixture F4 (ledger before, incoming batch from it on).
LEDGER_CUTOFF = "2024-01-16 00:00:00"
# --------------------------------------------------------------------------


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the reader (file listing, footers, schema) is made once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    memo = (spark.sparkContext.applicationId, path)
    if memo not in _TABLES:
        _TABLES[memo] = spark.read.parquet(path)
    return _TABLES[memo]


def _prop_k() -> Column:
    return F.get_json_object(F.col("props"), "$.k")


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def ticket_requests(events: DataFrame) -> DataFrame:
    """one ticket request per event."""
    eid = F.col("event_id")
    uid = _s("user_id")
    idx = (eid % F.lit(len(REQUEST_TEMPLATES))).cast("int") + F.lit(1)
    subjects = F.array(*[F.lit(s) for s, _ in REQUEST_TEMPLATES])
    bodies = F.array(*[F.lit(b) for _, b in REQUEST_TEMPLATES])
    return events.select(
        eid.alias("event_id"),
        F.concat(F.lit("TCK-"), _s(eid)).alias("ticket_id"),
        F.when(eid % 7 == 3, F.concat(F.lit("GUEST-"), uid))
        .when(eid % 5 == 0, F.concat(F.lit(" cust-"), uid, F.lit(" ")))
        .otherwise(F.concat(F.lit("CUST-"), uid))
        .alias("customer_id"),
        F.when(eid % 4 != 0, F.concat(F.lit("user"), uid, F.lit("@example.com"))).alias("customer_email"),
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
        .when(eid % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("IDEMP-"), uid, F.lit("-"), _prop_k()))
        .alias("idempotency_key"),
        F.element_at(subjects, idx).alias("subject"),
        F.element_at(bodies, idx).alias("body"),
        F.col("ts").alias("created_at"),
        F.floor(F.col("value") * 10).cast("int").alias("execution_time_ms"),
    )


def accounts(customer: DataFrame) -> DataFrame:
    """the account dimension, one row for each customer."""
    key = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("CUST-"), _s(key)).alias("account_id"),
        F.col("c_name").alias("company_name"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), F.lit("Starter"))
        .otherwise(F.lit("Enterprise"))
        .alias("current_tier"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance_usd"),
        F.lit("USD").alias("currency"),
        (key % 3).cast("int").alias("overdue_invoices_count"),
        ((key % 3) * 250).cast("decimal(18,2)").alias("overdue_amount_usd"),
        (F.lit(10000) + (key % 5) * 10000).cast("decimal(18,2)").alias("credit_limit_usd"),
        F.when(key % 2 == 0, F.lit("ANNUAL")).otherwise(F.lit("MONTHLY")).alias("billing_cycle"),
        (F.lit(10) + key % 90).cast("int").alias("seats_allocated"),
        F.when(F.col("c_acctbal") < 0, F.lit("OVERDUE_WARNING")).otherwise(F.lit("ACTIVE")).alias("status"),
    )


TIER_SCHEMA = T.StructType(
    [
        T.StructField("tier_key", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("monthly_cost", T.DecimalType(10, 2), False),
        T.StructField("max_seats", T.IntegerType(), False),
        T.StructField("sla_hours", T.IntegerType(), False),
    ]
)


def tiers(spark: SparkSession) -> DataFrame:
    """the three-row tier price list (size fixed, so broadcast is safe).

    Built as a JVM literal (``inline`` of an array of structs), so it plans as
    a local relation: no Python rows to serialise, no Python worker.
    """
    rows = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(t, TIER_SCHEMA.fields)])
        for t in C.TIERS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def requested_tier(event_id: Column) -> Column:
    """F3 (SCL-13): tier asked for by event; 'Gold' is not a known tier."""
    return (
        F.when(event_id % 10 == 0, F.lit("Gold"))
        .when(event_id % 10 < 4, F.lit(" starter "))
        .when(event_id % 10 < 7, F.lit("Professional"))
        .otherwise(F.lit("enterprise"))
    )


def stored_actions(events: DataFrame) -> DataFrame:
    """stored action lists in the two shapes the ledger holds."""
    eid = F.col("event_id")
    k = _prop_k()
    return events.select(
        eid.alias("event_id"),
        F.when(
            eid % 4 == 0,
            F.concat(F.lit('[{"tool":"check_account_balance","status":"SUCCESS","details":{"n":'), k, F.lit("}}]")),
        )
        .when(
            eid % 4 == 1,
            F.concat(
                F.lit('[{"tool_name":"update_subscription_tier","parameters":{"n":'), k,
                F.lit('},"success":false,"error":"E'), k, F.lit('"},{"tool":"check_account_balance","status":"SUCCESS"}]'),
            ),
        )
        .when(eid % 20 == 2, F.lit('[{"tool":"check_account_balance","status":"FAILED"},{"success":true},{"tool_name":"x","result":{"r":1}}]'))
        .when(eid % 4 == 2, F.lit('[{"tool":"check_account_balance","status":"FAILED"}]'))
        .otherwise(F.lit("[]"))
        .alias("actions_json"),
    )


def model_responses(events: DataFrame) -> DataFrame:
    """structured model output and the raw model message per event."""
    eid = F.col("event_id")
    k = _prop_k()
    output = F.when(eid % 7 == 0, F.lit('{"category":"BILLING","confidence')).otherwise(
        F.concat(
            F.lit('{"category":"BILLING","confidence_score":'),
            F.when(eid % 5 == 0, F.lit("1.5")).otherwise(F.lit("0.9")),
            F.lit(',"requires_escalation":false,"reasoning":"r'),
            k,
            F.lit('"'),
            F.when(eid % 3 == 0, F.lit("}")).otherwise(F.lit(',"customer_reply":"ok"}')),
        )
    )
    message = (
        F.when(eid % 4 == 0, F.lit('{"content":"done","tool_calls":[]}'))
        .when(eid % 4 == 1, F.lit('{"content":"done","tool_calls":[{"name":"wipe_disk","args":{}}]}'))
        .otherwise(
            F.concat(
                F.lit('{"content":"done","tool_calls":[{"name":"check_account_balance","args":{"account_id":"CUST-'),
                _s("user_id"),
                F.lit('"}}]}'),
            )
        )
    )
    return events.select(
        eid.alias("event_id"),
        F.concat(F.lit("TCK-"), _s(eid)).alias("ticket_id"),
        F.col("user_id"),
        F.col("ts").alias("created_at"),
        output.alias("output_json"),
        message.alias("message_json"),
    )


def model_messages(events: DataFrame) -> DataFrame:
    """F1 with the message a model gave: no, one or several ordered tool calls, some of them unknown, incomplete or for an unknown tier."""
    requests = ticket_requests(events)
    eid, account = F.col("event_id"), F.concat(F.lit('"account_id":"'), F.col("customer_id"), F.lit('"'))
    call = lambda name, *args: F.concat(F.lit(f'{{"name":"{name}","args":{{'), *args, F.lit("}}"))
    tier = lambda t: call(C.TOOL_TIER, account, F.lit(',"new_tier":"'), t, F.lit('"'))
    balance, unknown = call(C.TOOL_BALANCE, account), F.lit('{"name":"wipe_disk","args":{}}')
    message = lambda content, *calls: F.concat(F.lit(f'{{"content":{content},"tool_calls":['), F.concat_ws(",", *calls), F.lit("]}"))
    kinds = [
        message('"done"'),
        message('"done"', unknown),
        message('"done"', balance),
        message('"done"', tier(requested_tier(eid))),
        message('""', tier(F.lit("Starter")), balance, tier(F.lit("Enterprise"))),
        message('"done"', call(C.TOOL_BALANCE)),
        message('"done"', call(C.TOOL_TIER, account), balance, call(C.TOOL_TIER)),
        message("null", unknown, tier(F.lit(" professional "))),
    ]
    chosen = F.when(eid % 8 == 0, kinds[0])
    for i, k in enumerate(kinds[1:], 1):
        chosen = chosen.when(eid % 8 == i, k)
    return requests.withColumn("message_json", chosen)


def workflow_failures_raw(events: DataFrame) -> DataFrame:
    """workflow-failure JSON documents, one per error event."""
    eid = F.col("event_id")
    return events.filter(F.col("event_type") == "error").select(
        F.concat(
            F.lit('{"execution":{"id":"'),
            _s(eid),
            F.lit('"'),
            F.when(eid % 3 == 0, F.lit("")).otherwise(
                F.concat(F.lit(',"error":{"message":"m'), _prop_k(), F.lit('","stack":"s"}'))
            ),
            F.lit('},"workflow":{"name":"wf-'),
            _s(F.col("user_id") % 4),
            F.lit('"}}'),
        ).alias("failure_json"),
        F.col("ts").alias("failed_at"),
    )


def broken_requests(events: DataFrame) -> DataFrame:
    """F8: F1 with rule-breaking values, plus priority and confidence columns."""
    eid = F.col("event_id")
    base = ticket_requests(events)
    return base.select(
        "event_id",
        F.when(eid % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("ticket_id")).alias("ticket_id"),
        "customer_id",
        "idempotency_key",
        F.when(eid % 29 == 0, F.lit(""))
        .when(eid % 37 == 0, F.repeat(F.lit("x"), 256))
        .otherwise(F.col("subject"))
        .alias("subject"),
        F.when(eid % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("body")).alias("body"),
        "created_at",
        "execution_time_ms",
        F.when(eid % 41 == 0, F.lit("NOW")).otherwise(F.lit(C.DEFAULT_PRIORITY)).alias("priority"),
        F.when(eid % 43 == 0, F.lit(Decimal("12.5")).cast("decimal(10,3)"))
        .otherwise(F.lit(Decimal("0.9")).cast("decimal(10,3)"))
        .alias("confidence_raw"),
    )


def audit_entries(events: DataFrame) -> DataFrame:
    """audit entries as they arrive, some of them broken; the payload is a map that may be missing or empty."""
    eid = F.col("event_id")
    text = F.lit(None).cast("string")
    return events.select(
        "event_id",
        F.when(eid % 23 == 0, text).when(eid % 37 == 0, F.repeat(F.lit("s"), 65)).otherwise(F.lit(C.STEP_INGESTION)).alias("step_name"),
        F.when(eid % 29 == 0, text).when(eid % 31 == 0, F.lit("DONE")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.when(eid % 41 == 0, F.lit(-5)).when(eid % 5 == 0, F.lit(None)).otherwise((eid % 400).cast("int")).cast("int").alias("latency_ms"),
        F.when(eid % 43 == 0, F.lit(Decimal("1.5"))).otherwise(F.lit(Decimal("0.9"))).cast("decimal(4,3)").alias("confidence_score"),
        F.when(eid % 7 == 0, F.lit(None))
        .when(eid % 3 == 0, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("ticket_id"), F.concat(F.lit("TCK-"), eid.cast("string"))))
        .alias("input_payload"),
    )


def model_service_responses(events: DataFrame) -> DataFrame:
    """whole responses as they arrive, some of them broken: confidence, status, none to two actions."""
    eid = F.col("event_id")
    act = lambda tool, ok: F.struct(F.lit(tool).cast("string").alias("tool_name"), F.lit(ok).cast("boolean").alias("success"))
    acts = (
        F.when(eid % 47 == 0, F.lit(None))
        .when(eid % 4 == 0, F.array().cast("array<struct<tool_name:string,success:boolean>>"))
        .when(eid % 41 == 0, F.array(act(None, True)))
        .when(eid % 6 == 1, F.array(act(C.TOOL_BALANCE, True), act(C.TOOL_TIER, None)))
        .otherwise(F.array(act(C.TOOL_BALANCE, True)))
    )
    return events.select(
        "event_id",
        F.when(eid % 23 == 0, F.lit(Decimal("1.5"))).when(eid % 29 == 0, F.lit(Decimal("-0.1"))).when(eid % 13 == 0, F.lit(None)).otherwise(F.lit(Decimal("0.9"))).cast("decimal(4,3)").alias("confidence_score"),
        F.when(eid % 31 == 0, F.lit("PENDING")).when(eid % 37 == 0, F.lit(None)).when(eid % 5 == 0, F.lit("NEEDS_INFO")).otherwise(F.lit("RESOLVED")).alias("status"),
        acts.alias("actions_taken"),
    )


#: F12: days of one delivery slot.
SLOT_DAYS = 4


def deliveries(requests: DataFrame) -> DataFrame:
    """requests as a feed that delivers at least once: ``slot`` says when a copy arrives.

    A request arrives in the slot of its time, every 19th one slot later, every 31st three later; every 7th comes
    twice in its slot, every 5th again one slot later and every 3rd again three slots later.
    """
    eid = F.col("event_id")
    own = F.floor(epoch_seconds("created_at") / F.lit(SLOT_DAYS * 86400)) + F.when(eid % 19 == 0, 1).when(eid % 31 == 0, 3).otherwise(0)
    again = [F.when(eid % n == 0, F.lit(late)) for n, late in ((7, 0), (5, 1), (3, 3))]
    copies = F.array_compact(F.array(F.lit(0), *again))
    return requests.withColumn("late", F.explode(copies)).withColumn("slot", (own + F.col("late")).cast("long")).drop("late")
