"""Ledger upsert semantics, contracts, KPI and cost-model goldens."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from triage_spark.operators import contract as CT
from triage_spark.operators import kpis as K
from triage_spark.operators import ledger as L
from triage_spark.plans import ledger_flow as LF
from triage_spark.schemas import LEDGER_SCHEMA
from triage_spark.sources import fixtures as FX


def _ledger_row(spark, key, status, reply, ts):
    import datetime as dt

    vals = {f.name: None for f in LEDGER_SCHEMA.fields}
    vals.update(
        idempotency_key=key, ticket_key=key, ticket_id=f"T-{key}", customer_id="C", subject="s", body="b",
        category="BILLING", priority="HIGH", status=status, confidence_score=Decimal("0.930"),
        resolution_summary="r", customer_reply=reply, actions_taken="[]", execution_time_ms=1,
        cost_estimate_usd=Decimal("0.0280"), created_at=dt.datetime(2024, 1, ts), updated_at=dt.datetime(2024, 1, ts),
    )
    return tuple(vals[f.name] for f in LEDGER_SCHEMA.fields)


def test_upsert_overwrites_only_mutable_columns(spark):
    old = spark.createDataFrame([_ledger_row(spark, "A", "PENDING", "old", 1), _ledger_row(spark, "B", "RESOLVED", "keep", 1)], LEDGER_SCHEMA)
    new_a = _ledger_row(spark, "A", "RESOLVED", "new", 5)
    new_c = _ledger_row(spark, "C", "ESCALATED", "ins", 5)
    batch = spark.createDataFrame([new_a, new_c], LEDGER_SCHEMA).withColumn("category", F.lit("TECHNICAL")).withColumn(
        "priority", F.lit("MEDIUM")).withColumn("cost_estimate_usd", F.lit(Decimal("0.0300")).cast("decimal(6,4)"))
    up = {r.idempotency_key: r for r in L.upsert(old, batch).collect()}
    assert (up["A"].change, up["A"].status, up["A"].customer_reply) == ("UPDATED", "RESOLVED", "new")
    # category, priority, cost and created_at stay as first written
    assert (up["A"].category, up["A"].priority, up["A"].cost_estimate_usd) == ("BILLING", "HIGH", Decimal("0.0280"))
    assert up["A"].created_at.day == 1 and up["A"].updated_at.day == 5
    assert (up["B"].change, up["B"].customer_reply) == ("KEPT", "keep")
    assert (up["C"].change, up["C"].category) == ("INSERTED", "TECHNICAL")


def test_fixture_ledger_counts(spark):
    li = LF.prepare(spark, "/root/testdata/sf0.01")
    up = LF.upserted(li)
    counts = {r.change: r.n for r in up.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"INSERTED": 3582, "UPDATED": 100, "KEPT": 4339}
    assert up.select("idempotency_key").distinct().count() == up.count() == 8021


def test_contract_split_keeps_every_row(spark, sf_small):
    f8 = FX.broken_requests(FX.table(spark, sf_small, "events"))
    good, bad = CT.split(CT.check(f8, CT.request_rules()))
    assert good.count() + bad.count() == f8.count()
    assert bad.filter(F.col("n_violations") == 0).count() == 0


def test_fixture_contract_counts(spark):
    f8 = FX.broken_requests(FX.table(spark, "/root/testdata/sf0.01", "events"))
    eid = F.col("event_id")
    assert [f8.filter(eid % m == 0).count() for m in (23, 29, 31, 37, 41, 43)] == [435, 345, 323, 271, 244, 233]
    from triage_spark.plans.queries import _ledger_candidates

    both = CT.check(_ledger_candidates(f8), CT.ledger_rules() + CT.request_rules(), name="v")
    assert both.filter("n_violations > 0").count() == 1712


def test_kpis_on_five_seed_rows(spark):
    df = spark.createDataFrame(
        [("RESOLVED", 420), ("RESOLVED", 380), ("ESCALATED", 310), ("ESCALATED", 340), ("RESOLVED", 450)],
        "status string, execution_time_ms int",
    )
    r = K.kpi_summary(df).first()
    assert (r.total_tickets, r.resolved_tickets, r.escalated_tickets) == (5, 3, 2)
    assert (r.auto_resolution_rate_pct, r.avg_execution_latency_ms, r.time_saved_pct) == (60.0, 380.0, 99.96)
    assert r.cost_savings_usd == Decimal("18.66")


def test_kpis_empty_input(spark):
    r = K.kpi_summary(spark.createDataFrame([], "status string, execution_time_ms int")).first()
    assert (r.total_tickets, r.auto_resolution_rate_pct, r.avg_execution_latency_ms) == (0, 0.0, 0.0)


def test_cost_model_worked_example(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 725, "RESOLVED").otherwise("ESCALATED").alias("status"))
    r = K.cost_model(df, (5000,)).first()
    assert (r.auto_resolved, r.escalated) == (3625, 1375)
    assert (r.manual_cost_usd, r.automated_cost_usd) == (Decimal("31250.00"), Decimal("8702.50"))
    assert (r.monthly_saving_usd, r.yearly_saving_usd) == (Decimal("22547.50"), Decimal("270570.00"))


def test_status_distribution_shares(spark):
    df = spark.createDataFrame([("RESOLVED",)] * 3 + [("ESCALATED",)] + [(None,)], "status string")
    out = rows(K.status_distribution(df))
    assert out == [("ESCALATED", 1, 25.0), ("RESOLVED", 3, 75.0)]


def test_every_action_reaches_the_ledger_text(spark):
    import json

    kind = "actions_taken array<struct<tool_name:string,parameters:map<string,string>,result:string,success:boolean,error:string>>"
    one = ("a", {"x": "1"}, '{"n":1}', True, None)
    two = ('b"]', None, None, False, "bad [x]")
    df = spark.createDataFrame([([],), ([one],), ([one, two],), ([two, one, two],)], kind)
    got = [json.loads(r[0]) for r in df.select(L.actions_json()).collect()]
    item = {"a": {"tool_name": "a", "parameters": {"x": "1"}, "result": {"n": 1}, "success": True, "error": None}, "b": {"tool_name": 'b"]', "parameters": {}, "result": {}, "success": False, "error": "bad [x]"}}
    assert got == [[], [item["a"]], [item["a"], item["b"]], [item["b"], item["a"], item["b"]]]


def test_rows_without_a_key_are_not_folded(spark):
    from triage_spark.operators.dedupe import first_per_key, with_key

    df = spark.createDataFrame([(None, None, 1, "a"), ("", None, 1, "b"), (None, "t", 1, "c"), ("k", "t", 2, "d"), ("k", "t", 1, "e")], "idempotency_key string, ticket_id string, created_at long, body string")
    assert sorted(r.body for r in first_per_key(with_key(df)).collect()) == ["a", "b", "c", "e"]


def test_reports_prune_the_stored_ledger(spark, sf_small):
    from triage_spark.plans import queries as Q

    plan = Q.QUERIES["route_counts"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    schema = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert len(schema) == 1 and "status" in schema[0] and "body" not in schema[0]


def test_empty_payload_is_null_and_missing_latency_is_zero(spark):
    from triage_spark.operators import audit as AU

    entries = spark.createDataFrame([({}, None), (None, 3), ({"a": "1"}, -2)], "input_payload map<string,string>, latency_ms int")
    assert [tuple(r) for r in AU.entry_rows(entries).collect()] == [(None, 0), (None, 3), ('{"a":"1"}', -2)]


def test_defaults_fill_omitted_columns_only(spark, tmp_path):
    from triage_spark.operators import ledger as L

    left_out = spark.createDataFrame([("a", "T1")], "idempotency_key string, ticket_id string")
    given = spark.createDataFrame([("b", "T2", None, None)], "idempotency_key string, ticket_id string, status string, cost_estimate_usd decimal(6,4)")
    got = {r.idempotency_key: r for r in L.insert_rows([left_out, given], str(tmp_path / "t")).collect()}
    assert (got["a"].status, got["a"].category, got["a"].priority, got["a"].actions_taken, got["a"].execution_time_ms, str(got["a"].cost_estimate_usd)) == ("PENDING", "GENERAL", "MEDIUM", "[]", 0, "0.0300")
    assert got["b"].status is None and got["b"].cost_estimate_usd is None and got["b"].category == "GENERAL"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledger_")]


def test_counts_of_an_empty_feed_are_zero(spark, tmp_path):
    from triage_spark.operators import contract as CT

    none = spark.createDataFrame([], "step_name string, status string, latency_ms int, confidence_score decimal(4,3)")
    counts = CT.store_checked(CT.check(none, CT.audit_rules()), CT.audit_rules(), str(tmp_path / "c"))
    assert counts["rows"] == counts["broken"] == counts["STATUS_DOMAIN"] == 0
