"""Feeds, model output, stored actions and routing texts."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from triage_spark.operators import model_feed as MF
from triage_spark.operators import routing as RT
from triage_spark.sources import feeds as FD


def test_stored_action_shapes(spark):
    df = spark.createDataFrame(
        [
            (1, '[{"tool":"check_account_balance","status":"SUCCESS","details":{"n":4}}]'),
            (2, '[{"tool_name":"update_subscription_tier","success":false,"error":"E1"}]'),
            (3, '[{"tool":"check_account_balance","status":"FAILED"}]'),  # no success field -> true
            (4, "[]"),
            (5, '[{"status":"SUCCESS"},{"tool_name":"x","success":true,"result":{"a":1}}]'),
        ],
        "event_id int, actions_json string",
    )
    out = rows(MF.normalize_actions(df), "event_id", "pos", "tool_name", "success", "result_json", "error")
    assert out == [
        (1, 0, "check_account_balance", True, '{"n":4}', None),
        (2, 0, "update_subscription_tier", False, "{}", "E1"),
        (3, 0, "check_account_balance", True, "{}", None),
        (5, 0, "unknown", True, "{}", None),
        (5, 1, "x", True, '{"a":1}', None),
    ]


def test_model_output_contract(spark):
    df = spark.createDataFrame(
        [
            (1, '{"category":"BILLING","confidence'),
            (2, '{"category":"BILLING","confidence_score":1.5,"requires_escalation":false,"reasoning":"r","customer_reply":"ok"}'),
            (3, '{"category":"BILLING","confidence_score":0.9,"requires_escalation":false,"reasoning":"r"}'),
            (4, '{"category":"BILLING","confidence_score":0.9,"requires_escalation":false,"reasoning":"r","customer_reply":"ok"}'),
            (5, '{"category":"BILLING","confidence_score":0.9,"requires_escalation":true,"reasoning":"r","customer_reply":"ok","priority":"HIGH"}'),
            (6, '{"category":"X","confidence_score":0.9,"requires_escalation":false,"reasoning":"r","customer_reply":"ok","priority":"NOW"}'),
        ],
        "event_id int, output_json string",
    )
    out = {r.event_id: (r.violation_text, r.status, r.priority) for r in MF.judge_output(df).collect()}
    assert out[1] == ("MALFORMED_JSON", "ESCALATED", "MEDIUM")
    assert out[2] == ("CONFIDENCE_RANGE", "ESCALATED", "MEDIUM")
    assert out[3] == ("CUSTOMER_REPLY_REQUIRED", "ESCALATED", "MEDIUM")
    assert out[4] == ("", "RESOLVED", "MEDIUM")
    assert out[5] == ("", "ESCALATED", "HIGH")
    assert out[6] == ("PRIORITY_DOMAIN", "ESCALATED", "NOW")


def test_model_tool_calls(spark):
    df = spark.createDataFrame(
        [
            (1, '{"content":"done","tool_calls":[]}'),
            (2, '{"content":"done","tool_calls":[{"name":"wipe_disk","args":{}}]}'),
            (3, '{"content":"","tool_calls":[{"name":"check_account_balance","args":{"account_id":"A"}}]}'),
            (4, '{"content":"x","tool_calls":[{"name":"update_subscription_tier","args":{"account_id":"A"}}]}'),
        ],
        "event_id int, message_json string",
    )
    out = {r.event_id: (r.confidence_score, r.status, r.customer_reply) for r in MF.model_actions(df).collect()}
    assert out[1] == (Decimal("0.650"), "ESCALATED", "done")
    assert out[2] == (Decimal("0.650"), "ESCALATED", "done")  # unknown tool dropped
    assert out[3] == (Decimal("0.850"), "RESOLVED", "Your request has been processed.")
    assert out[4] == (Decimal("0.650"), "ESCALATED", "x")  # missing new_tier: the call fails


def test_failure_feed_defaults(spark):
    df = spark.createDataFrame(
        [
            ('{"execution":{"id":"7","error":{"message":"m1","stack":"s"}},"workflow":{"name":"wf-1"}}', dt.datetime(2024, 1, 2, 3, 4, 5, 678901)),
            ('{"execution":{"id":"8"},"workflow":{"name":"wf-2"}}', dt.datetime(2024, 1, 2, 3, 4, 6)),
        ],
        "failure_json string, failed_at timestamp_ntz",
    )
    f = FD.parse_failures(df)
    out = {r.execution_id: (r.error_message, r.error_stack, r.workflow_name) for r in f.collect()}
    assert out == {"7": ("m1", "s", "wf-1"), "8": ("Unknown runtime failure", "", "wf-2")}
    alert = f.select(RT.ops_alert().alias("a")).select("a.*").filter("attachments[0].title like '%ID: 7%'").first()
    one = alert.attachments[0]
    assert one.title == "Workflow: wf-1 (ID: 7)" and one.fields[1].value == "2024-01-02T03:04:05.678Z"


def test_request_json_permissive(spark):
    df = spark.createDataFrame(
        [(1, '{"ticket_id":"T1","customer_id":"C","subject":"s","body":"b"}'), (2, 'x{"ticket_id":"T2"}')],
        "event_id int, value string",
    )
    out = {r.event_id: (r.ticket_id, r.is_corrupt) for r in FD.parse_requests(df).collect()}
    assert out == {1: ("T1", False), 2: (None, True)}


def test_route_texts(spark):
    df = spark.createDataFrame(
        [("TCK-1", "BILLING", Decimal("0.930"), "RESOLVED", "r", "hi"), ("TCK-2", "GENERAL", Decimal("0.550"), "ESCALATED", "why", "sorry")],
        "ticket_id string, category string, confidence_score decimal(4,3), status string, reasoning string, customer_reply string",
    )
    routed = {r.ticket_id: r.route for r in RT.with_route(df).collect()}
    assert routed == {"TCK-1": "resolution_card", "TCK-2": "escalation_task"}
    card = df.filter("status = 'RESOLVED'").select(F.to_json(RT.resolution_card(F.lit("[]"))).alias("j")).first().j
    assert '"title":"Confidence Score","value":"93.0%"' in card
    task = df.filter("status = 'ESCALATED'").select(RT.escalation_task().alias("t")).select("t.*").first()
    assert task.name == "🚨 ESCALATION: TCK-2 - GENERAL"
    assert task.description == (
        "### Human Triage Required\n\n**Reasoning:** why\n**Confidence:** 55.0% (Threshold: 80%)"
        "\n\n**Customer Response Sent:**\n>sorry"
    )
    assert task.tags == ["ai-escalation", "tier-2-review", "general"]
