"""The account table in the state store equals the aggregate over all calls, also after restarts."""

import datetime as dt
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from triage_spark.operators import accounts as A
from triage_spark.plans import queries as Q
from triage_spark.sources import fixtures as FX
from triage_spark.streaming import account_fold as AF
from triage_spark.streaming import jobs as SJ

REPORT = list(Q.STATE_REPORT)


def feed(df, root):
    df.select(*AF.CALLS.fieldNames()).write.mode("append").parquet(f"{root}/calls")


def test_parts_in_time_order_equal_the_aggregate(spark, sf_small):
    i = Q.inputs(spark, sf_small)
    calls = Q.reaching_calls(i)
    root = tempfile.mkdtemp(prefix="fold-", dir="/tmp")
    run = SJ.new_run(spark, "t", root)
    cuts = ["2024-01-08", "2024-01-20", "2024-02-20"]
    low = "2023-01-01"
    for high in cuts:
        feed(calls.filter((F.col("created_at") >= low) & (F.col("created_at") < high)), root)
        state = SJ.account_fold_stream(spark, f"{root}/calls", i.accounts, run)
        want = A.account_state(i.accounts, calls.filter(F.col("created_at") < high))
        assert rows(state, *REPORT) == rows(want, *REPORT)
        low = high
    # nothing new: the next start changes nothing, and fields that no call moves are those of the account table
    again = SJ.account_fold_stream(spark, f"{root}/calls", i.accounts, run)
    assert rows(again) == rows(want, *again.columns)


@pytest.fixture(scope="module")
def base(spark, sf_small):
    known = FX.accounts(FX.table(spark, sf_small, "customer")).limit(1)
    return known.withColumn("account_id", F.lit("A")).withColumn("current_tier", F.lit("Starter")).withColumn("seats_allocated", F.lit(20))


def t(minutes):
    return None if minutes is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def calls_of(spark, listed):
    return spark.createDataFrame([(a, t(m), k, c, tier, n) for a, m, k, c, tier, n in listed], AF.CALLS)


def test_edges(spark, base):
    """Order inside a batch, ties, repeated rows, nulls in any column, an account that a call meets first, an empty part."""
    parts = [
        [("A", 5, "T2", True, "Enterprise", 500), ("A", 5, "T1", True, "Professional", 100), ("A", 9, "T9", False, None, None)],
        [],
        # earlier than the first part's, but it arrives later; repeated rows count
        [("A", 1, "T0", True, "Starter", 10), ("A", 1, "T0", True, "Starter", 10)],
        [("N", None, None, True, "Professional", None), ("N", None, "T3", None, None, None), (None, 3, "T4", True, "Enterprise", 500), ("N", None, None, False, "Enterprise", 9)],
    ]
    root = tempfile.mkdtemp(prefix="fold-", dir="/tmp")
    run = SJ.new_run(spark, "t", root)
    for part in parts:
        feed(calls_of(spark, part), root)
        state = SJ.account_fold_stream(spark, f"{root}/calls", base, run)
    got = {r.account_id: (r.current_tier, r.seats_allocated, r.tier_changes, r.tool_calls, r.is_new) for r in state.collect()}
    seats = A.C.DEFAULT_ACCOUNT["seats_allocated"]
    assert got == {"A": ("Starter", 250, 4, 5, False), "N": ("Professional", seats, 1, 3, True), None: ("Enterprise", max(seats, 250), 1, 1, True)}


def test_a_hot_account_is_folded_before_the_shuffle(spark):
    """Arrow batches of the hot account come out as one row each, and equal the aggregate."""
    n = 30_000
    hot = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "H").otherwise(F.concat(F.lit("C"), F.col("id") % 50)).alias("account_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, hash(id) % 1000000)").alias("created_at"), F.concat(F.lit("T"), "id").alias("ticket_id"),
        (F.col("id") % 4 == 0).alias("is_change"), F.element_at(F.array(*map(F.lit, ["Starter", "Professional", "Enterprise"])), (F.hash("id") % 3 + 4).cast("int") % 3 + 1).alias("tier_name"), (F.col("id") % 97).cast("int").alias("max_seats"),
    )
    folded = hot.mapInPandas(AF.partial, AF.PARTIAL)
    assert folded.filter("account_id = 'H'").count() < 40
    want = hot.groupBy("account_id").agg(
        F.max(F.when(F.col("is_change"), F.struct("created_at", "ticket_id", "tier_name"))).alias("m"),
        F.floor(F.max(F.when(F.col("is_change"), F.col("max_seats"))) / 2).cast("int").alias("half"), F.count_if("is_change").alias("changes"), F.count("*").alias("calls"),
    ).select("account_id", "m.tier_name", "half", "changes", "calls")
    got = folded.groupBy("account_id").agg(F.max(F.when(F.col("changes") > 0, F.struct("last_at", "last_ticket", "last_tier"))).alias("m"), F.max("half").alias("half"), F.sum("changes").alias("changes"), F.sum("calls").alias("calls"))
    assert rows(got.select("account_id", "m.last_tier", "half", "changes", "calls")) == rows(want)


def test_partial_of_no_rows_is_empty():
    none = pd.DataFrame({"account_id": pd.Series([], dtype="object"), "created_at": pd.Series([], dtype="datetime64[us]"), "ticket_id": pd.Series([], dtype="object"),
                         "is_change": pd.Series([], dtype="bool"), "tier_name": pd.Series([], dtype="object"), "max_seats": pd.Series([], dtype="int32")})
    assert [len(p) for p in AF.partial(iter([none]))] == [0]
