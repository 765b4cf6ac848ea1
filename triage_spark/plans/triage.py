"""The ticket pipeline as one logical plan per use.

read -> contract -> effective key -> classify (map-side) -> first per key ->
account lookup -> tier price -> gate -> texts, with the account sequence
(previous tier, running seats) on a narrow branch of tier changes that joins
back by key.

Two entry points:

* ``decide`` -- key, dedupe, classify, gate.  Needs no account data, because
  the rule path's confidence does not depend on it (the requested tier is
  always a valid one).  This is what reports and routing read.
* ``resolve`` -- everything, including balances, tier changes and texts.

Both are plain DataFrame transforms; the same functions run inside
``foreachBatch`` for streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rules import classify_columns, dec
from ..functions.text import confirmation_id
from ..operators import accounts as A
from ..operators.dedupe import ORDER, first_fields, first_per_key, row_hash, with_key
from ..operators.gate import gate, rule_reasoning, rule_reply, with_gated_reasoning
from ..operators.skew import DEFAULT_HOT_ROWS
from ..operators.tools import dispatch_json
from ..sources import fixtures as FX


@dataclass
class Inputs:
    requests: DataFrame
    accounts: DataFrame
    tiers: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Inputs:
    events = FX.table(spark, sf_dir, "events")
    return Inputs(
        requests=FX.ticket_requests(events),
        accounts=FX.accounts(FX.table(spark, sf_dir, "customer")),
        tiers=FX.tiers(spark),
    )


def classify(df: DataFrame) -> DataFrame:
    """SCL-2..7 as columns next to the input columns."""
    return df.select("*", *classify_columns())


CLASS_COLUMNS = ["category", "target_tier", "confidence_score"]


def decide(
    requests: DataFrame, threshold: Decimal = C.CONFIDENCE_THRESHOLD, keep: Sequence[str] | None = None
) -> DataFrame:
    """First-per-key tickets with category, target tier, confidence and gate.

    Classification is a pure per-row function, so it runs *before* the dedupe,
    next to the scan.  With ``keep`` (the request columns a report needs) the
    texts are consumed map-side and only key, order, ``keep`` and the three
    rule columns travel through the dedupe shuffle; with ``keep=None`` every
    request column is kept.
    """
    keyed = with_key(requests)
    # ties on the order: a hash of the whole request row, as in ``resolve``,
    # so reports and responses always agree on which ticket came first
    cls = classify(keyed).withColumn("_tb", row_hash(keyed))
    if keep is not None:
        cls = cls.select("key", *ORDER, "_tb", *[c for c in keep if c not in ORDER], *CLASS_COLUMNS)
    return gate(first_per_key(cls, order=(*ORDER, "_tb"), hash_ties=False).drop("_tb"), threshold)


def resolve(
    requests: DataFrame,
    accounts: DataFrame,
    tiers: DataFrame,
    threshold: Decimal = C.CONFIDENCE_THRESHOLD,
    chunk_seconds: int = A.DEFAULT_CHUNK_SECONDS,
    hot_rows: int = DEFAULT_HOT_ROWS,
    deduped: bool = False,
    keep: Sequence[str] | None = None,
    tier_col: str | None = None,
    hot: DataFrame | None = None,
    classified: bool = False,
) -> DataFrame:
    """Full outcome per first-per-key ticket (the response of the service).

    ``tier_col`` names a request column that holds the tier asked for, in place of the one read from the
    text; a tier that is not on the list then fails the tool, and the failure is data all the way (SCL-7, SCL-32).

    Tools run only for first-per-key tickets (repeats never reach a tool), so
    account state advances once per key.

    Unless ``deduped``, classification runs map-side, before the dedupe, and
    with ``keep`` (the request columns a report needs besides key, order and
    customer_id) only those go through the dedupe shuffle: a report that
    never shows the ticket body does not shuffle it.  Ties on the order are
    broken by a hash of the whole request row, so every variant picks the
    same first row.
    """
    # ``classified``: ``requests`` went through ``classify`` before it was stored, so no branch reads the texts again
    category, target_tier, confidence = [F.col(c) for c in CLASS_COLUMNS] if classified else classify_columns()
    is_sub = category == "SUBSCRIPTION"
    if tier_col is not None:
        target_tier = F.when(is_sub, F.col(tier_col)).alias("target_tier")
    outcome = [category, target_tier, confidence]
    # only subscription tickets can change a tier: the rest carry a flag and no tier
    narrow_cols = {
        "is_sub": is_sub,
        "customer_id": F.col("customer_id"),
        "target_tier": target_tier,
    }
    if deduped:  # ``requests`` is already one row per key (a persisted batch, say)
        df = requests.select(*[c for c in requests.columns if not (classified and c in CLASS_COLUMNS)], *outcome)
        narrow = requests.select("key", *ORDER, *[v.alias(k) for k, v in narrow_cols.items()])
    else:
        keyed = with_key(requests)
        payload = [c for c in keyed.columns if c not in ("key", *ORDER)]
        if keep is not None:
            payload = [c for c in payload if c in keep or c == "customer_id"]
        cls = keyed.select("key", *ORDER, row_hash(keyed).alias("_tb"), *payload, *outcome)
        df = first_per_key(cls, order=(*ORDER, "_tb"), hash_ties=False).drop("_tb")
        # the same first rows, but only key, order and three short columns shuffled
        narrow = first_fields(keyed, narrow_cols)
    # Hot accounts are counted on the input as given (before the dedupe when
    # there is one): a superset of the hot accounts among first tickets, found
    # with a map-side-combined count instead of a second dedupe shuffle.
    # ``hot``: the same list, if it was counted before.
    hot = A.hot_accounts(requests, hot_rows=hot_rows) if hot is None else hot
    # WIN-2/3 on a narrow branch of tier changes only (no text, no account
    # columns).  It ends in one row per key, partitioned by key, and joins back
    # where ``df`` is already partitioned by key: the wide rows are not
    # shuffled for the scan, and a report that reads none of its columns
    # drops the branch (left join on a unique key).
    subs = narrow.filter(F.col("is_sub")).withColumn("account_id", A.normalize_id("customer_id"))
    changes = A.join_tiers(subs, tiers, "target_tier").filter(F.col("tier_valid"))
    seq = A.change_sequence(changes, "key", chunk_seconds, hot=hot)
    df = df.join(seq, "key", "left")
    # The account is looked up on the narrow branch as well and joins back by key (one row per key on both
    # sides), so the texts are shuffled once, for the dedupe, and the outcome stays partitioned by key.
    asked = narrow.select("key", "ticket_id", "customer_id")
    found = A.lookup_accounts(
        asked, accounts, "customer_id", salt_by=["ticket_id"], hot_rows=hot_rows, hot=A.hot_marker(hot)
    )
    df = df.join(found.drop("ticket_id", "customer_id"), "key", "left")
    df = A.join_tiers(df, tiers, "target_tier")
    is_change = (F.col("category") == "SUBSCRIPTION") & F.col("tier_valid")
    df = A.with_base(df.withColumn("is_change", is_change))
    tool_ok = F.when(F.col("category") == "SUBSCRIPTION", F.col("tier_valid")).otherwise(F.lit(True))
    df = df.withColumn(
        "confidence_score",
        F.when((F.col("category") == "SUBSCRIPTION") & ~tool_ok, dec(C.CONF_TIER_CHANGE_FAILED)).otherwise(
            F.col("confidence_score")
        ),
    )
    df = df.withColumns(
        {
            "confirmation_id": F.when(
                F.col("is_change"), confirmation_id("created_at")
            ).otherwise(F.lit("N/A")),
            "balance_usd": F.col("acct_balance_usd"),
            "overdue_invoices_count": F.col("acct_overdue_invoices_count"),
        }
    )
    df = gate(df, threshold)
    df = df.withColumns({"reasoning": rule_reasoning(threshold), "customer_reply": rule_reply()})
    df = with_gated_reasoning(df)
    return df.withColumn("actions_taken", actions_column())


def tool_name_col() -> Column:
    """Which tool the rule path calls for the row's category (null: none)."""
    return F.when(F.col("category") == "SUBSCRIPTION", F.lit(C.TOOL_TIER)).when(
        F.col("category") == "BILLING", F.lit(C.TOOL_BALANCE)
    )


def tool_call_struct() -> Column:
    """The single action of a rule-path ticket (ToolCallResult), or null."""
    name = tool_name_col()
    params = F.when(
        F.col("category") == "SUBSCRIPTION",
        F.create_map(F.lit("account_id"), F.col("customer_id"), F.lit("new_tier"), F.col("target_tier")),
    ).otherwise(F.create_map(F.lit("account_id"), F.col("customer_id")))
    is_sub = F.col("category") == "SUBSCRIPTION"
    success = F.when(is_sub, F.col("tier_valid")).otherwise(F.lit(True))
    error = F.when(is_sub & ~F.col("tier_valid"), F.format_string(C.TPL_TIER_INVALID, F.col("target_tier")))
    return F.when(
        name.isNotNull(),
        F.struct(
            name.alias("tool_name"),
            params.alias("parameters"),
            dispatch_json(name).alias("result"),
            success.alias("success"),
            error.alias("error"),
        ),
    )


def actions_column() -> Column:
    """actions_taken as ``array<struct<tool_name, parameters, result(json), success, error>>``."""
    one = tool_call_struct()
    return F.when(one.isNull(), F.array().cast(
        "array<struct<tool_name:string,parameters:map<string,string>,result:string,success:boolean,error:string>>"
    )).otherwise(F.array(one))
