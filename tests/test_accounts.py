"""Per-account order-dependent state: the chunked scan equals one plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from triage_spark.operators import accounts as A
from triage_spark.plans import triage as TR
from triage_spark.sources import fixtures as FX


def _tool_rows(spark, sf, hot=False):
    i = TR.load(spark, sf)
    req = i.requests
    if hot:  # a third of all tickets on one account
        req = req.withColumn("customer_id", F.when(F.col("event_id") % 3 == 0, F.lit("CUST-7")).otherwise(F.col("customer_id")))
    df = TR.classify(req)
    df = A.lookup_accounts(df, i.accounts, hot_rows=50)
    df = A.join_tiers(df, i.tiers, "target_tier")
    return df.withColumn("is_change", (F.col("category") == "SUBSCRIPTION") & F.col("tier_valid"))


def _brute(df):
    w = Window.partitionBy("account_id").orderBy("created_at", "ticket_id")
    ct = F.when(F.col("is_change"), F.col("tier_name"))
    half = F.when(F.col("is_change"), F.floor(F.col("max_seats") / 2).cast("int"))
    return df.select(
        "ticket_id",
        F.coalesce(F.last(ct, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("acct_current_tier")).alias("previous_tier"),
        F.greatest(F.col("acct_seats_allocated"), F.max(half).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("seats_after"),
    )


@pytest.mark.parametrize("chunk", [60, 3600, 86400, 40 * 86400])
@pytest.mark.parametrize("hot", [False, True])
def test_chunked_sequence_equals_window(spark, sf_small, chunk, hot):
    df = _tool_rows(spark, sf_small, hot)
    got = A.account_sequence(df, chunk).select("ticket_id", "previous_tier", "seats_after")
    assert rows(got) == rows(_brute(df))


def test_account_state_matches_last_change(spark, sf_small):
    df = _tool_rows(spark, sf_small)
    i = TR.load(spark, sf_small)
    seq = A.account_sequence(df)
    state = A.account_state(i.accounts, A.tool_calls(seq))
    last = (
        seq.filter("is_change")
        .groupBy("account_id")
        .agg(F.max_by("tier_name", F.struct("created_at", "ticket_id")).alias("t"), F.max("seats_after").alias("s"))
    )
    j = state.join(last, "account_id")
    assert j.filter((F.col("t") != F.col("current_tier")) | (F.col("s") != F.col("seats_allocated"))).count() == 0
    # accounts never touched keep their row; every fixture account is present
    assert state.filter(~F.col("is_new")).count() == i.accounts.count()


def test_default_account_row(spark):
    tickets = spark.createDataFrame([("TCK-1", "  new-corp\t")], "ticket_id string, customer_id string")
    accounts = FX.accounts(spark.createDataFrame([(4, "x", 1, 1.0, "BUILDING")],
                                                 "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    r = A.lookup_accounts(tickets, accounts).first()
    assert r.account_id == "NEW-CORP"
    assert (r.account_found, r.acct_current_tier, r.acct_seats_allocated, r.acct_company_name) == (
        False, "Professional", 25, "Enterprise Account NEW-CORP")


def test_invalid_tier(spark):
    df = spark.createDataFrame([("Gold",), (" starter ",)], "t string")
    out = {r.t: (r.tier_valid, r.tier_name) for r in A.join_tiers(df, FX.tiers(spark), "t").collect()}
    assert out == {"Gold": (False, None), " starter ": (True, "Starter")}


def test_adaptive_chunks_for_hot_account(spark, sf_small):
    df = _tool_rows(spark, sf_small, hot=True)
    hot = A.hot_accounts(df, hot_rows=100)
    assert hot.count() == 1  # CUST-7 holds a third of the tickets
    got = A.account_sequence(df, 3600, hot=hot, hot_parts=10).select("ticket_id", "previous_tier", "seats_after")
    assert rows(got) == rows(_brute(df))


def test_a_burst_is_cut_evenly(spark):
    """One old row, then 200,000 rows within an hour: no chunk holds more than twice its share."""
    df = spark.range(200_000).select(
        F.lit("CUST-1").alias("account_id"),
        F.when(F.col("id") == 0, F.lit("2020-01-01").cast("timestamp_ntz")).otherwise((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 0.018)).cast("timestamp_ntz")).alias("created_at"),
    )
    hot = spark.createDataFrame([("CUST-1", 200_000)], "account_id string, n long")
    cuts = A.hot_cuts(df, hot, 200).first()._cuts
    times = [r[0] for r in df.select(A.epoch_micros("created_at")).collect()]
    import bisect
    from collections import Counter

    assert max(Counter(bisect.bisect_right(cuts, t) for t in times).values()) <= 2 * 1000
