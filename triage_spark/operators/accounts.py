"""Accounts and tiers: lookup with a default row, tier changes and account state.

JOIN-2, JOIN-3, SCL-12/13, SCL-28, SCL-31/32, WIN-2..4, UDF-1.

Order-dependent state (previous tier, running seats) is a prefix scan per
account.  A per-account window would put a hot account (a third of all
tickets) into one task, so the scan is split in time chunks:

1. rows are windowed per ``(account, chunk)`` where ``chunk`` is a fixed-width
   slice of event time: each slice is its own task;
2. every ``(account, chunk)`` is summarised to one row (last tier, chunk max);
3. a window per account runs over those summaries only (one row per chunk,
   so the per-account group is bounded by time span / chunk width);
4. the carry (tier and max before the chunk) is joined back on
   ``(account, chunk)``, the key the rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rules import normalize_id
from ..functions.text import confirmation_id, effective_date, epoch_micros
from .skew import DEFAULT_HOT_ROWS, heavy_hitters, skew_join

ORDER = ("created_at", "ticket_id")
DEFAULT_CHUNK_SECONDS = 3600

ACCOUNT_FIELDS = [
    "company_name",
    "current_tier",
    "balance_usd",
    "currency",
    "overdue_invoices_count",
    "overdue_amount_usd",
    "credit_limit_usd",
    "billing_cycle",
    "seats_allocated",
    "status",
]


def default_account_values(account_id: Column) -> dict[str, Column]:
    d = C.DEFAULT_ACCOUNT
    return {
        "company_name": F.concat(F.lit(d["company_name_prefix"]), account_id),
        "current_tier": F.lit(d["current_tier"]),
        "balance_usd": F.lit(d["balance_usd"]).cast("decimal(18,2)"),
        "currency": F.lit(d["currency"]),
        "overdue_invoices_count": F.lit(d["overdue_invoices_count"]).cast("int"),
        "overdue_amount_usd": F.lit(d["overdue_amount_usd"]).cast("decimal(18,2)"),
        "credit_limit_usd": F.lit(d["credit_limit_usd"]).cast("decimal(18,2)"),
        "billing_cycle": F.lit(d["billing_cycle"]),
        "seats_allocated": F.lit(d["seats_allocated"]).cast("int"),
        "status": F.lit(d["status"]),
    }


def lookup_accounts(
    tickets: DataFrame,
    accounts: DataFrame,
    id_col: str = "customer_id",
    salt_by: list[str] | None = None,
    hot_rows: int = DEFAULT_HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """JOIN-2 + SCL-12: attach the account (or the default row) to every ticket.

    Adds ``account_id`` (normalised id), ``account_found`` and the account
    fields prefixed ``acct_``.  The join is an equi join on the normalised id,
    salted for hot accounts; the account table is never broadcast blindly
    because it grows with the customer base.
    """
    t = tickets.withColumn("account_id", normalize_id(id_col))
    a = accounts.select(
        "account_id", F.lit(True).alias("account_found"), *[F.col(c).alias(f"acct_{c}") for c in ACCOUNT_FIELDS]
    )
    joined = skew_join(t, a, ["account_id"], "left", salt_by=salt_by or ["ticket_id"], hot_rows=hot_rows, hot=hot)
    found = F.coalesce(F.col("account_found"), F.lit(False))
    defaults = default_account_values(F.col("account_id"))
    return joined.withColumn("account_found", found).withColumns(
        {f"acct_{c}": F.when(found, F.col(f"acct_{c}")).otherwise(defaults[c]) for c in ACCOUNT_FIELDS}
    )


def hot_accounts(requests: DataFrame, id_col: str = "customer_id", hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Accounts holding at least ``hot_rows`` requests.

    Found on the raw feed by a frequent-items sketch, so the list is bounded (``skew.MOST_HOT``): safe to
    broadcast.  Columns: account_id, n.
    """
    return heavy_hitters(requests.select(normalize_id(id_col).alias("account_id")), "account_id", hot_rows)


def join_tiers(df: DataFrame, tiers: DataFrame, tier_col: str) -> DataFrame:
    """JOIN-3 + SCL-13: price-list columns for a requested tier name.

    The tier list has a fixed size (three rows), so it is broadcast.
    Adds tier_key, tier_name, monthly_cost, max_seats, sla_hours, tier_valid.
    """
    t = tiers.select(
        F.col("tier_key").alias("_tk"),
        F.col("name").alias("tier_name"),
        "monthly_cost",
        "max_seats",
        "sla_hours",
    )
    out = df.withColumn("tier_key", normalize_id(tier_col))
    out = out.join(F.broadcast(t), out["tier_key"] == t["_tk"], "left")
    return out.withColumn("tier_valid", F.col("_tk").isNotNull()).drop("_tk")


#: Chunks that a hot account is cut into, at quantiles of its own times.
HOT_PARTS = 256


def hot_marker(hot: DataFrame) -> DataFrame:
    """The hot-account list for salting (account_id, _hot), off the same aggregate that the chunks use."""
    return hot.select("account_id", (F.col("n") > 0).alias("_hot"))


def hot_cuts(df: DataFrame, hot: DataFrame, parts: int = HOT_PARTS) -> DataFrame:
    """account_id, _cuts: the times that cut each hot account's rows of ``df`` into ``parts`` even chunks.

    Quantiles follow the arrivals, so a burst is cut as finely as it is dense.
    At most ``parts`` numbers for each hot account: safe to broadcast.
    """
    quantiles = [i / parts for i in range(1, parts)]
    mine = df.join(F.broadcast(hot.select("account_id")), "account_id", "left_semi")
    return mine.groupBy("account_id").agg(F.percentile_approx(epoch_micros("created_at"), quantiles, 100 * parts).alias("_cuts"))


def change_carry(
    df: DataFrame,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    hot: DataFrame | None = None,
    hot_parts: int = HOT_PARTS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The account prefix scan without the account's base values.

    Needs account_id, created_at, ticket_id, is_change, tier_name, max_seats
    (other columns pass through).  Adds ``prev_change_tier`` (tier of the
    account's last change strictly before the row, null if none) and
    ``run_max_half`` (largest ``max_seats // 2`` over the account's changes up
    to and including the row, null if none).

    Chunk width: ``chunk_seconds`` for ordinary accounts (an account below
    the hot threshold has fewer rows than that in total); a hot account (from
    ``hot_accounts``, broadcast, bounded) is cut at ``hot_parts`` quantiles of its
    own times.  Chunk numbers grow with time inside an account, which is all the
    carry step needs.
    """
    change_tier = F.when(F.col("is_change"), F.col("tier_name"))
    change_half = F.when(F.col("is_change"), F.floor(F.col("max_seats") / 2).cast("int"))
    t = epoch_micros("created_at")
    chunk = F.floor(t / F.lit(chunk_seconds * 1_000_000).cast("double"))
    if hot is not None:
        df = df.join(F.broadcast(hot_cuts(df, hot, hot_parts)), "account_id", "left")
        passed = F.size(F.filter("_cuts", lambda c: c <= t)).cast("long")
        chunk = F.when(F.col("_cuts").isNotNull(), passed).otherwise(chunk)
    rows = df.withColumns(
        {
            "_chunk": chunk,
            "_ct": change_tier,
            "_half": change_half,
        }
    )
    order = [F.col(c) for c in order]
    w_in = Window.partitionBy("account_id", "_chunk").orderBy(*order)
    rows = rows.withColumns(
        {
            "_lag_in": F.last("_ct", ignorenulls=True).over(w_in.rowsBetween(Window.unboundedPreceding, -1)),
            "_max_in": F.max("_half").over(w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    summary = rows.groupBy("account_id", "_chunk").agg(
        F.max(F.when(F.col("is_change"), F.struct(*order, F.col("_ct").alias("t")))).alias("_last"),
        F.max("_half").alias("_cmax"),
    )
    w_acc = Window.partitionBy("account_id").orderBy("_chunk")
    carry = summary.select(
        "account_id",
        "_chunk",
        F.last("_last.t", ignorenulls=True).over(w_acc.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_last"),
        F.max("_cmax").over(w_acc.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_max"),
    )
    out = rows.join(carry, ["account_id", "_chunk"], "left")
    return out.withColumns(
        {
            "prev_change_tier": F.coalesce(F.col("_lag_in"), F.col("_prev_last")),
            "run_max_half": F.greatest(F.col("_max_in"), F.col("_prev_max")),
        }
    ).drop("_chunk", "_ct", "_half", "_lag_in", "_max_in", "_prev_last", "_prev_max", "_cuts")


def with_base(df: DataFrame) -> DataFrame:
    """previous_tier / seats_after from the carry and the account's base row."""
    return df.withColumns(
        {
            "previous_tier": F.coalesce(F.col("prev_change_tier"), F.col("acct_current_tier")),
            "seats_after": F.greatest(F.col("acct_seats_allocated"), F.col("run_max_half")),
        }
    ).drop("prev_change_tier", "run_max_half")


def account_sequence(
    df: DataFrame,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    hot: DataFrame | None = None,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """WIN-2/3 over every row of ``df`` (rows with is_change carry a tier).

    Non-change rows pass through the same windows untouched.  Needs the
    columns of ``change_carry`` plus acct_current_tier, acct_seats_allocated.
    """
    return with_base(change_carry(df, chunk_seconds, hot, hot_parts))


def change_sequence(
    changes: DataFrame,
    key: str = "key",
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    hot: DataFrame | None = None,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """WIN-2/3 on the tier changes alone: one row per change, keyed by ``key``.

    ``changes`` holds only valid tier changes, narrow (key, account_id,
    created_at, ticket_id, tier_name, max_seats).  Only changes move an
    account's tier or seats, so the scan needs no other ticket and no account
    column; the result (key, prev_change_tier, run_max_half) is joined back to
    the wide rows by key, where they are already partitioned after the dedupe.
    """
    c = changes.select(key, "account_id", *ORDER, "tier_name", "max_seats", F.lit(True).alias("is_change"))
    # One row per key already; the aggregate makes that known to the planner
    # (so an unused branch is pruned) and its shuffle on key is the one the
    # join back needs anyway.
    return (
        change_carry(c, chunk_seconds, hot, hot_parts)
        .groupBy(key)
        .agg(F.max("prev_change_tier").alias("prev_change_tier"), F.max("run_max_half").alias("run_max_half"))
    )


def tier_change_result(account_id: str = "account_id") -> Column:
    """SCL-32: the tool result struct of ``update_subscription_tier``."""
    ok = F.col("tier_valid")
    return F.when(
        ok,
        F.struct(
            F.lit(True).alias("success"),
            F.col(account_id).alias("account_id"),
            F.col("previous_tier").alias("previous_tier"),
            F.col("tier_name").alias("new_tier"),
            F.col("monthly_cost").cast("double").alias("monthly_cost_usd"),
            F.col("max_seats").alias("max_seats"),
            effective_date("created_at").alias("effective_date"),
            confirmation_id("created_at").alias("confirmation_id"),
            F.format_string(C.TPL_TIER_MESSAGE, F.col(account_id), F.col("tier_name")).alias("message"),
        ),
    )


def tier_failure_result(asked: Column) -> Column:
    """SCL-32: the result struct of ``update_subscription_tier`` for a tier that is not on the list."""
    return F.struct(F.lit(False).alias("success"), F.format_string(C.TPL_TIER_INVALID, asked).alias("error"))


def balance_result(prefix: str = "acct_") -> Column:
    """SCL-31: the tool result struct of ``check_account_balance`` (10 fields)."""
    p = prefix
    return F.struct(
        F.lit(True).alias("success"),
        F.col("account_id").alias("account_id"),
        F.col(f"{p}company_name").alias("company_name"),
        F.col(f"{p}balance_usd").cast("double").alias("balance_usd"),
        F.col(f"{p}currency").alias("currency"),
        F.col(f"{p}overdue_invoices_count").alias("overdue_invoices_count"),
        F.col(f"{p}overdue_amount_usd").cast("double").alias("overdue_amount_usd"),
        F.col(f"{p}credit_limit_usd").cast("double").alias("credit_limit_usd"),
        F.col(f"{p}status").alias("status"),
        F.date_format(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def account_state(
    accounts: DataFrame,
    tool_calls: DataFrame,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """WIN-4: every account after all tickets (all account fields kept).

    ``tool_calls``: one row per processed (first-per-key) ticket that reached a
    tool, with account_id, created_at, ticket_id, is_change (valid tier change),
    tier_name, max_seats.  Accounts first seen by a tool get the default row.
    The per-account fold is an aggregate (partial + final), so a hot account
    is combined before the shuffle; the dimension and the fold meet in one
    full outer join with at most one row per key on each side.
    """
    half = F.floor(F.col("max_seats") / 2).cast("int")
    touched = tool_calls.groupBy("account_id").agg(
        F.max(F.when(F.col("is_change"), F.struct(*[F.col(c) for c in order], F.col("tier_name").alias("t")))).alias(
            "_last"
        ),
        F.max(F.when(F.col("is_change"), half)).alias("_max_half"),
        F.count_if(F.col("is_change")).alias("tier_changes"),
        F.count(F.lit(1)).alias("tool_calls"),
    )
    carried = [c for c in ("tier_changes", "tool_calls", "is_new") if c in accounts.columns]
    base = accounts.select(
        "account_id", *ACCOUNT_FIELDS, *[F.col(c).alias(f"_base_{c}") for c in carried], F.lit(True).alias("_known")
    )
    j = base.join(touched, "account_id", "full_outer")
    defaults = default_account_values(F.col("account_id"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    fields = {c: F.when(known, F.col(c)).otherwise(defaults[c]) for c in ACCOUNT_FIELDS}
    fields["current_tier"] = F.coalesce(F.col("_last.t"), fields["current_tier"])
    fields["seats_allocated"] = F.greatest(fields["seats_allocated"], F.col("_max_half"))
    changes = F.coalesce(F.col("tier_changes"), F.lit(0)).cast("bigint")
    calls = F.coalesce(F.col("tool_calls"), F.lit(0)).cast("bigint")
    is_new = ~known
    # A state table as base (streams): counts accumulate, "new" sticks.
    if "tier_changes" in carried:
        changes = changes + F.coalesce(F.col("_base_tier_changes"), F.lit(0))
    if "tool_calls" in carried:
        calls = calls + F.coalesce(F.col("_base_tool_calls"), F.lit(0))
    if "is_new" in carried:
        is_new = F.coalesce(F.col("_base_is_new"), F.lit(False)) | ~known
    return j.select(
        "account_id",
        *[v.alias(k) for k, v in fields.items()],
        changes.alias("tier_changes"),
        calls.alias("tool_calls"),
        is_new.alias("is_new"),
    )


TOOL_CALL_COLUMNS = ["account_id", "category", *ORDER, "is_change", "tier_name", "max_seats"]


def tool_calls(resolved: DataFrame) -> DataFrame:
    """Tool calls that reach an account: balance checks and valid tier changes.

    An unknown tier is rejected before the account is looked up, so it
    neither creates nor changes an account.  The input of ``account_state``.
    """
    reaches = (F.col("category") == "BILLING") | ((F.col("category") == "SUBSCRIPTION") & F.col("is_change"))
    return resolved.filter(reaches).select(
        "account_id", *ORDER, "is_change", "tier_name", "max_seats"
    )
