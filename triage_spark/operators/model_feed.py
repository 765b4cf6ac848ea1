"""Model-response feed and stored actions (SRC-7, FLT-4, SCL-14..16, SCL-19, CON-8, AGG-10).

Model answers arrive as a table of JSON texts; they are parsed with
``from_json`` (PERMISSIVE, corrupt text kept) and judged by column rules.
Arrays of tool calls are handled with higher-order functions (``filter``,
``transform``, ``forall``) inside the row, so nothing is exploded and
re-grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rules import dec
from ..functions.text import gate_message
from .contract import Rule, check
from .gate import threshold_col
from .tools import known_tool

CORRUPT = "_corrupt_record"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

STRUCTURED_OUTPUT = (
    "category string, priority string, confidence_score double, requires_escalation boolean, "
    f"reasoning string, tool_to_call string, tool_args map<string,string>, customer_reply string, {CORRUPT} string"
)
MODEL_MESSAGE = "content string, tool_calls array<struct<name:string,args:map<string,string>>>"
STORED_ACTIONS = (
    "array<struct<tool:string,tool_name:string,status:string,success:boolean,"
    "details:string,result:string,parameters:string,error:string>>"
)
# Required arguments per tool; a call without them raises in the service.
REQUIRED_ARGS = {C.TOOL_BALANCE: ["account_id"], C.TOOL_TIER: ["account_id", "new_tier"]}


def parse_output(df: DataFrame, col: str = "output_json") -> DataFrame:
    return df.withColumn("out", F.from_json(F.col(col), STRUCTURED_OUTPUT, PERMISSIVE))


def output_rules() -> list[Rule]:
    """CON-8 over the parsed ``out`` struct."""
    o = F.col("out")
    conf = o["confidence_score"]
    return [
        ("MALFORMED_JSON", o[CORRUPT].isNotNull()),
        ("CATEGORY_REQUIRED", o[CORRUPT].isNull() & o["category"].isNull()),
        ("CONFIDENCE_REQUIRED", o[CORRUPT].isNull() & conf.isNull()),
        ("CONFIDENCE_RANGE", (conf < 0) | (conf > 1)),
        ("ESCALATION_FLAG_REQUIRED", o[CORRUPT].isNull() & o["requires_escalation"].isNull()),
        ("REASONING_REQUIRED", o[CORRUPT].isNull() & o["reasoning"].isNull()),
        ("CUSTOMER_REPLY_REQUIRED", o[CORRUPT].isNull() & o["customer_reply"].isNull()),
        ("PRIORITY_DOMAIN", o["priority"].isNotNull() & ~o["priority"].isin(*C.TICKET_PRIORITIES)),
    ]


def judge_output(df: DataFrame, threshold=C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """CON-8: bad output -> ESCALATED; good output -> flag or confidence gate."""
    checked = check(parse_output(df), output_rules())
    o = F.col("out")
    thr = threshold_col(threshold).cast("double")
    status = (
        F.when(F.col("n_violations") > 0, F.lit("ESCALATED"))
        .when(o["requires_escalation"] | (o["confidence_score"] < thr), F.lit("ESCALATED"))
        .otherwise(F.lit("RESOLVED"))
    )
    return checked.withColumns(
        {
            "category": o["category"],
            "priority": F.coalesce(o["priority"], F.lit(C.DEFAULT_PRIORITY)),
            "model_confidence": o["confidence_score"],
            "status": status,
        }
    )


def tool_calls(message_col: str = "message_json") -> Column:
    return F.from_json(F.col(message_col), MODEL_MESSAGE)["tool_calls"]


def _call_ok(call: Column) -> Column:
    """A known tool call succeeds unless a required argument is missing (SCL-15, Q14)."""
    cond = None
    for tool, args in REQUIRED_ARGS.items():
        present = None
        for a in args:
            p = call["args"][a].isNotNull()
            present = p if present is None else present & p
        branch = (call["name"] == tool) & present
        cond = branch if cond is None else cond | branch
    return F.coalesce(cond, F.lit(False))


def model_actions(df: DataFrame, message_col: str = "message_json", threshold=C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """SRC-7 + FLT-4 + SCL-14/15 + AGG-10 on the model path.

    Unknown tools are dropped; confidence 0.85 when at least one call and all
    succeeded, else 0.65; category is always GENERAL (Q15); the gate decides.
    """
    msg = F.from_json(F.col(message_col), MODEL_MESSAGE)
    calls = F.coalesce(msg["tool_calls"], F.array().cast("array<struct<name:string,args:map<string,string>>>"))
    kept = F.filter(calls, lambda c: known_tool(c["name"]))
    actions = F.transform(
        kept,
        lambda c: F.struct(
            c["name"].alias("tool_name"),
            _call_ok(c).alias("success"),
            F.when(~_call_ok(c), F.lit("missing required argument")).alias("error"),
        ),
    )
    out = df.withColumns({"_content": msg["content"], "_actions": actions, "_n_calls": F.size(calls)})
    all_ok = (F.size("_actions") > 0) & F.forall("_actions", lambda a: a["success"])
    conf = F.when(all_ok, dec(C.CONF_MODEL_ALL_OK)).otherwise(dec(C.CONF_MODEL_OTHER))
    thr = threshold_col(threshold)
    out = out.withColumn("confidence_score", conf)
    return out.select(
        "*",
        F.lit("GENERAL").alias("category"),
        F.when(F.col("confidence_score") < thr, F.lit("ESCALATED")).otherwise(F.lit("RESOLVED")).alias("status"),
        F.concat(
            F.lit(C.MODEL_REASONING + " ["), gate_message(F.col("confidence_score"), thr), F.lit("]")
        ).alias("reasoning"),
        F.coalesce(F.nullif(F.col("_content"), F.lit("")), F.lit(C.MODEL_DEFAULT_REPLY)).alias("customer_reply"),
    )


def normalized(stored: Column) -> Column:
    """SCL-16 + SCL-19: stored actions in either shape as an array of structs of one shape; null if the text holds no list.

    ``tool`` or ``tool_name`` (else ``unknown``); success is
    ``status == 'SUCCESS' or success (default true)`` (Q13: FAILED without a
    success field reads as true); parameters are kept; result is ``details`` or ``result``.
    """
    return F.transform(
        F.from_json(stored, STORED_ACTIONS),
        lambda a: F.struct(
            F.coalesce(a["tool"], a["tool_name"], F.lit("unknown")).alias("tool_name"),
            (F.coalesce(a["status"] == "SUCCESS", F.lit(False)) | F.coalesce(a["success"], F.lit(True))).alias(
                "success"
            ),
            F.coalesce(a["parameters"], F.lit("{}")).alias("parameters_json"),
            F.coalesce(a["details"], a["result"], F.lit("{}")).alias("result_json"),
            a["error"].alias("error"),
        ),
    )


def normalize_actions(df: DataFrame, col: str = "actions_json") -> DataFrame:
    """One row for each stored action."""
    return df.select("*", F.posexplode(normalized(F.col(col))).alias("pos", "action")).select(
        *df.columns, "pos", "action.*"
    )
