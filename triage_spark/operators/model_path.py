"""The model path that acts (SRC-7, FLT-4, SCL-14/15, WIN-2/3, AGG-10): tool calls of a model's message, run in order.

A message may call tools several times, and calls move accounts as on the rule path: the tier before a call
is that of the account's last valid change, by (time, ticket, number of the call).  Calls become rows (``posexplode``),
go through the same account lookup, price join and chunked scan as rule-path tickets, and return to their
ticket by an aggregate on its key, bounded by the calls of one message.

A call without a required argument fails with that argument named and reaches no account; one for a tier that is
not on the list succeeds as a call, with ``success: false`` in its result.  Unknown tools are dropped.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rules import dec
from . import accounts as A
from .dedupe import ORDER
from .gate import gate, with_gated_reasoning
from .model_feed import MODEL_MESSAGE, REQUIRED_ARGS
from .skew import DEFAULT_HOT_ROWS, heavy_hitters
from .tools import dispatch_json, known_tool

CALL_ORDER = (*ORDER, "call_no")
ACTION = "struct<tool_name:string,parameters:map<string,string>,result:string,success:boolean,error:string>"


def missing_arguments(name: Column, args: Column) -> Column:
    """The error text of a call without all its required arguments; null for a complete one."""
    out = None
    for tool, wanted in REQUIRED_ARGS.items():
        lost = F.filter(F.array(*[F.when(args[a].isNull(), F.lit(f"'{a}'")) for a in wanted]), lambda x: x.isNotNull())
        plural = F.when(F.size(lost) > 1, F.lit("s")).otherwise(F.lit(""))
        text = F.when(F.size(lost) > 0, F.format_string(C.TPL_MISSING_ARGUMENT, F.lit(tool), F.size(lost), plural, F.array_join(lost, " and ")))
        out = F.when(name == tool, text) if out is None else out.when(name == tool, text)
    return out


def call_rows(tickets: DataFrame, message: str = "message_json") -> DataFrame:
    """key, created_at, ticket_id, call_no, tool_name, args, new_tier, error and asked_account of every call of a known tool."""
    calls = tickets.select("key", *ORDER, F.posexplode(F.from_json(F.col(message), MODEL_MESSAGE)["tool_calls"]).alias("call_no", "c"))
    calls = calls.filter(known_tool(F.col("c")["name"])).select("key", *ORDER, "call_no", F.col("c")["name"].alias("tool_name"), F.coalesce(F.col("c")["args"], F.create_map().cast("map<string,string>")).alias("args"))
    calls = calls.withColumns({"new_tier": F.col("args")["new_tier"], "error": missing_arguments(F.col("tool_name"), F.col("args"))})
    # Calls without an account must not meet on one null key.
    return calls.withColumn("asked_account", F.coalesce(F.col("args")["account_id"], F.concat(F.lit("?"), "key")))


def run_calls(calls: DataFrame, accounts: DataFrame, tiers: DataFrame, chunk_seconds: int = A.DEFAULT_CHUNK_SECONDS, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """The calls with account, price and order columns and their ``result`` (JSON text; null for failed calls)."""
    valid = F.col("error").isNull() & (F.col("tool_name") == C.TOOL_TIER) & F.col("tier_valid")
    calls = A.join_tiers(calls, tiers, "new_tier").withColumn("is_change", F.coalesce(valid, F.lit(False)))
    asked = A.normalize_id("asked_account")
    hot = heavy_hitters(calls.select(asked.alias("account_id")), "account_id", hot_rows)
    changes = calls.filter("is_change").select("key", *CALL_ORDER, asked.alias("account_id"), "tier_name", "max_seats", "is_change")
    seen = A.change_carry(changes, chunk_seconds, hot=hot, order=CALL_ORDER).select("key", "call_no", "prev_change_tier", "run_max_half")
    calls = calls.join(seen, ["key", "call_no"], "left")
    calls = A.with_base(A.lookup_accounts(calls, accounts, "asked_account", salt_by=["key", "call_no"], hot_rows=hot_rows, hot=A.hot_marker(hot)))
    return calls.withColumn("result", F.when(F.col("error").isNull(), dispatch_json(F.col("tool_name"), "new_tier")))


def reaching(calls: DataFrame) -> DataFrame:
    """The calls that touch an account, as ``account_state`` takes them."""
    return calls.filter((F.col("error").isNull() & (F.col("tool_name") == C.TOOL_BALANCE)) | F.col("is_change")).select("account_id", *CALL_ORDER, "is_change", "tier_name", "max_seats")


def answered(tickets: DataFrame, calls: DataFrame, threshold: Decimal = C.CONFIDENCE_THRESHOLD, message: str = "message_json") -> DataFrame:
    """The tickets with the outcome of the model path, in the columns that ``ledger_rows`` reads."""
    action = F.struct("tool_name", F.col("args").alias("parameters"), "result", F.col("error").isNull().alias("success"), "error").cast(ACTION)
    of = calls.groupBy("key").agg(F.collect_list(F.struct("call_no", action.alias("a"))).alias("as"))
    ordered = F.array_sort("as", lambda x, y: x["call_no"] - y["call_no"])
    of = of.select("key", F.transform(ordered, lambda x: x["a"]).alias("actions_taken"))
    df = tickets.join(of, "key", "left").withColumn("actions_taken", F.coalesce("actions_taken", F.array().cast(f"array<{ACTION}>")))
    all_ok = (F.size("actions_taken") > 0) & F.forall("actions_taken", lambda a: a["success"])
    content = F.from_json(F.col(message), MODEL_MESSAGE)["content"]
    df = df.withColumns(
        {
            "category": F.lit(C.DEFAULT_CATEGORY),
            "confidence_score": F.when(all_ok, dec(C.CONF_MODEL_ALL_OK)).otherwise(dec(C.CONF_MODEL_OTHER)),
            "reasoning": F.lit(C.MODEL_REASONING),
            "customer_reply": F.coalesce(F.nullif(content, F.lit("")), F.lit(C.MODEL_DEFAULT_REPLY)),
        }
    )
    return with_gated_reasoning(gate(df, threshold))
