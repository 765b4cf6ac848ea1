"""The model path that acts, the failed tool as data, stored actions in cached replies, and JSON files as feeds."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from triage_spark.operators import accounts as A
from triage_spark.operators import ledger as L
from triage_spark.operators import model_path as MP
from triage_spark.operators.skew import heavy_hitters, hot_keys
from triage_spark.plans import triage as TR
from triage_spark.sources import feeds as FD
from triage_spark.sources import fixtures as FX
from triage_spark.streaming import jobs as SJ

COLS = "key string, event_id long, ticket_id string, customer_id string, customer_email string, subject string, body string, created_at timestamp_ntz, execution_time_ms int, message_json string"


def tickets(spark, messages):
    """One ticket a minute for each message (a dictionary or text)."""
    rows = [
        (f"K{i}", i, f"T{i}", "CUST-1", None, "s", "b", dt.datetime(2024, 1, 1, 0, i), 5, m if m is None or isinstance(m, str) else json.dumps(m))
        for i, m in enumerate(messages)
    ]
    return spark.createDataFrame(rows, COLS)


def tier(account, new, **more):
    return {"name": "update_subscription_tier", "args": {"account_id": account, "new_tier": new, **more}}


def balance(account):
    return {"name": "check_account_balance", "args": {"account_id": account}}


@pytest.fixture(scope="module")
def accounts(spark, sf_small):
    return FX.accounts(FX.table(spark, sf_small, "customer"))


def run(spark, accounts, messages, **options):
    t = tickets(spark, messages)
    calls = MP.run_calls(MP.call_rows(t), accounts, FX.tiers(spark), **options)
    rows = {r.idempotency_key: r for r in L.ledger_rows(MP.answered(t, calls)).collect()}
    return [(rows[f"K{i}"], json.loads(rows[f"K{i}"].actions_taken)) for i in range(len(messages))], calls


@pytest.mark.parametrize("options", [{}, {"chunk_seconds": 60}, {"hot_rows": 1}])
def test_ordered_calls_move_accounts_across_tickets(spark, accounts, options):
    got, calls = run(
        spark,
        accounts,
        [
            {"content": "a", "tool_calls": [tier("CUST-9", "Starter"), tier(" cust-9 ", "enterprise"), balance("CUST-9"), tier("CUST-9", "Professional")]},
            {"content": "", "tool_calls": [tier("new-1", "Gold"), tier("NEW-2", "Starter")]},
            {"content": None, "tool_calls": [tier("CUST-9", "Starter"), tier("new-2 ", "Enterprise")]},
        ],
        **options,
    )
    before = [[a["result"].get("previous_tier") for a in acts] for _, acts in got]
    base = accounts.filter("account_id = 'CUST-9'").first()
    assert before == [[base.current_tier, "Starter", None, "Enterprise"], [None, "Professional"], ["Professional", "Starter"]]
    # The call with an unknown tier did not raise, so it is a success whose result says otherwise.
    assert got[1][1][0]["success"] is True and got[1][1][0]["result"] == {"success": False, "error": "Invalid tier 'Gold'. Supported tiers are: STARTER, PROFESSIONAL, ENTERPRISE."}
    assert [r.status for r, _ in got] == ["RESOLVED"] * 3 and {float(r.confidence_score) for r, _ in got} == {0.85}
    assert [r.customer_reply for r, _ in got] == ["a", "Your request has been processed.", "Your request has been processed."]
    state = {r.account_id: r for r in A.account_state(accounts, MP.reaching(calls), MP.CALL_ORDER).collect()}
    assert state["CUST-9"].current_tier == "Starter" and state["CUST-9"].seats_allocated == max(base.seats_allocated, 500) and state["CUST-9"].tool_calls == 5
    assert "NEW-1" not in state and state["NEW-2"].is_new and state["NEW-2"].current_tier == "Enterprise"


def test_missing_arguments_are_named_and_escalate(spark, accounts):
    got, calls = run(
        spark,
        accounts,
        [
            {"content": "x", "tool_calls": [{"name": "check_account_balance", "args": {}}, balance("CUST-1")]},
            {"content": "x", "tool_calls": [{"name": "update_subscription_tier", "args": {"new_tier": "Starter"}}]},
            {"content": "x", "tool_calls": [{"name": "update_subscription_tier", "args": {"account_id": "CUST-1"}}]},
            {"content": "x", "tool_calls": [{"name": "update_subscription_tier"}]},
            {"content": "x", "tool_calls": [{"name": "wipe_disk", "args": {"account_id": "CUST-1"}}]},
            {"content": "x"},
            "not json",
            None,
        ],
    )
    errors = [[a["error"] for a in acts] for _, acts in got]
    need = "update_subscription_tier() missing"
    assert errors[:4] == [
        ["check_account_balance() missing 1 required positional argument: 'account_id'", None],
        [f"{need} 1 required positional argument: 'account_id'"],
        [f"{need} 1 required positional argument: 'new_tier'"],
        [f"{need} 2 required positional arguments: 'account_id' and 'new_tier'"],
    ]
    assert errors[4:] == [[]] * 4 and got[0][1][0]["result"] == {} and got[0][1][0]["success"] is False
    assert all(r.status == "ESCALATED" and float(r.confidence_score) == 0.65 and r.category == "GENERAL" for r, _ in got)
    assert MP.reaching(calls).count() == 1


def test_failed_tier_is_data_all_the_way(spark, accounts):
    t = tickets(spark, [None, None]).drop("message_json").withColumn("subject", F.lit("Upgrade")).withColumn("asked", F.element_at(F.array(F.lit("Gold"), F.lit("starter")), F.col("event_id").cast("int") + 1))
    rows = {r.key: r for r in TR.resolve(t, accounts, FX.tiers(spark), deduped=True, tier_col="asked").collect()}
    bad, good = rows["K0"], rows["K1"]
    assert (bad.status, float(bad.confidence_score), bad.gate_status) == ("ESCALATED", 0.5, "WARNING") and "confirmation N/A" in bad.reasoning
    a = bad.actions_taken[0]
    assert a.success is False and a.error.startswith("Invalid tier 'Gold'") and json.loads(a.result) == {"success": False, "error": a.error}
    assert good.status == "RESOLVED" and good.actions_taken[0].success and good.previous_tier == accounts.filter("account_id = 'CUST-1'").first().current_tier


def test_cached_actions_of_both_shapes(spark):
    stored = [
        '[{"tool":"t","status":"SUCCESS","details":{"n":1}},{"tool_name":"u","parameters":{"a":"b"},"result":{"r":2},"success":false,"error":"E"}]',
        '[{"tool":"t","status":"FAILED"},{}]',
        "[]",
        "no list",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(stored)), "i int, s string").select("i", L.cached_actions("s").alias("a"))
    got = {r.i: json.loads(r.a) for r in df.collect()}
    one = lambda name, p={}, r={}, ok=True, e=None: {"tool_name": name, "parameters": p, "result": r, "success": ok, "error": e}  # noqa: E731, B006
    assert got == {0: [one("t", r={"n": 1}), one("u", {"a": "b"}, {"r": 2}, False, "E")], 1: [one("t"), one("unknown")], 2: [], 3: [], 4: []}


def test_feed_files_lose_no_line(spark, sf_small, tmp_path):
    ev = FX.table(spark, sf_small, "events")
    path = FD.write_lines(FD.request_lines(ev), f"file://{tmp_path}/lines", 6)
    read = FD.read_requests(spark, path).cache()
    broken = ev.filter("event_id % 47 = 0 OR event_id % 53 = 0").count()
    good = read.filter(F.col(FD.CORRUPT).isNull())
    assert read.count() == ev.count() and good.count() == ev.count() - broken > 0 and broken > 0
    row = good.filter("ticket_id = 'TCK-1'").first()
    want = FX.ticket_requests(ev).filter("event_id = 1").first()
    assert row.metadata == {"channel": "portal", "event": "1"} and (row.customer_email, row.subject, row.created_at) == (want.customer_email, want.subject, want.created_at)
    streamed = SJ.feed_stream(spark, path, SJ.new_run(spark, "t-feed", f"file://{tmp_path}/run"), max_files=2)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, FD.feed_report(read).collect()))


def test_heavy_hitters_find_every_hot_key(spark):
    keys = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None).cast("string")).otherwise(F.col("id").cast("string"))
    df = spark.range(0, 60_000, 1, 16).select(keys.alias("k"), (F.col("id") % 2).alias("b"))
    assert [r.k for r in heavy_hitters(df, "k", 15_000).collect()] == ["hot"]
    assert sorted((r.k, r.b) for r in hot_keys(df, ["k", "b"], 8_000).collect()) == [("hot", 0), ("hot", 1)]
    assert heavy_hitters(df.limit(0), "k", 1).count() == 0
    plan = heavy_hitters(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan
