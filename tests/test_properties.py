"""Property tests (hypothesis) for the custom operators, and the audit shape."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from triage_spark.operators import accounts as A

TIERS = {"Starter": 20, "Professional": 100, "Enterprise": 1000}
T0 = dt.datetime(2024, 1, 1)

changes_st = st.lists(
    st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 400_000), st.sampled_from(sorted(TIERS))),
    min_size=1,
    max_size=40,
)


def _brute(changes):
    """Per account, in (time, ticket) order: tier of the previous change, running max of max_seats // 2."""
    out = {}
    by_acct = {}
    for i, (acct, sec, tier) in enumerate(changes):
        by_acct.setdefault(acct, []).append((T0 + dt.timedelta(seconds=sec), f"TCK-{i:03d}", tier))
    for rows in by_acct.values():
        prev, run = None, None
        for ts, tid, tier in sorted(rows):
            half = TIERS[tier] // 2
            run = half if run is None else max(run, half)
            out[tid] = (prev, run)
            prev = tier
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(changes=changes_st, chunk=st.sampled_from([1, 60, 3600, 86_400, 10**7]), chunk_rows=st.integers(1, 8))
def test_change_sequence_equals_fold(spark, changes, chunk, chunk_rows):
    rows = [(f"TCK-{i:03d}", acct, T0 + dt.timedelta(seconds=sec), tier, TIERS[tier])
            for i, (acct, sec, tier) in enumerate(changes)]
    df = spark.createDataFrame(rows, "ticket_id string, account_id string, created_at timestamp_ntz, tier_name string, max_seats int")
    df = df.withColumn("key", F.col("ticket_id"))
    # every account with at least 3 changes counts as hot here, so adaptive chunk widths are exercised
    hot = A.hot_accounts(df.withColumn("customer_id", F.col("account_id")), hot_rows=3)
    got = A.change_sequence(df, "key", chunk, hot=hot, hot_parts=chunk_rows + 1).collect()
    assert {r.key: (r.prev_change_tier, r.run_max_half) for r in got} == _brute(changes)


def test_audit_has_two_rows_per_processed_ticket(spark, sf_small):
    audit = E.queries()["audit_rows"](spark, sf_small)
    per = audit.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"), F.collect_set("step_name").alias("steps"))
    assert per.filter("n != 2").count() == 0
    assert per.filter(F.size("steps") != 2).count() == 0
    firsts = E.queries()["dedupe_first"](spark, sf_small)
    assert per.count() == firsts.count()
