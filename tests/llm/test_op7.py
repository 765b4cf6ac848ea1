import json
import random

import pytest

from triage_spark.llm.op7_chat_format import canonical, check_schema, checked, faults, format_chats, op7_chat_format

MESSAGES = "conv_id long, turn long, role string, text string, place int, kind string"
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string, depth int"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1, "maximum": 9}, "s": {"type": "string", "minLength": 2, "maxLength": 3}, "a": {"type": "array", "items": {"type": ["number", "null"]}}, "e": {"enum": [1, "u"]}}}}


def run(spark, messages=(), calls=(), results=()):
    frames = [spark.createDataFrame([(*r, *tail) for r in rows], cols) for rows, cols, tail in ((messages, MESSAGES, (0, "k")), (calls, CALLS, (1,)), (results, RESULTS, ("s",)))]
    return format_chats(*frames, SCHEMAS).orderBy("conv_id", "place", "step", "call_id").collect()


def test_canonical_json():
    assert canonical({"b": 1.0, "a": [True, None, 2.5, "é\n"], "€": {"z": 1, "y": 2}}) == '{"a":[true,null,2.5,"é\\n"],"b":1,"€":{"y":2,"z":1}}'
    assert canonical({"": 1, "😀": 2}) == '{"😀":2,"":1}'  # UTF-16 order
    value = {"k": [{"y": 1, "x": [1e30, -0.5]}]}
    assert json.loads(canonical(value)) == value


@pytest.mark.parametrize(
    "value, wrong",
    [({"x": 3}, 0), ({"x": 3.0}, 0), ({"x": True}, 1), ({}, 1), ({"x": 0}, 1), ({"x": 10, "q": 1}, 2), ({"x": 1, "s": "a"}, 1), ({"x": 1, "s": "abcd"}, 1), ({"x": 1, "a": [1, None, "t"]}, 1), ({"x": 1, "e": True}, 1), ({"x": 1, "e": "u"}, 0), ([], 1)],
)
def test_schema(value, wrong):
    assert len(faults(value, SCHEMAS["f"])) == wrong


@pytest.mark.parametrize("text", [None, "", "{", '{"x":1,"x":2}', "NaN", "1e999", "[" * 100_000, '{"x":"\\ud800"}', '{"\\udc00":1}', "[" * 990 + "]" * 990, "[" * 300 + "]" * 300])
def test_not_json(text):
    assert checked("f", text, SCHEMAS)[1] == ["not JSON"]


def test_links_and_states(spark):
    ok = '{"x": 1.0}'
    got = run(
        spark,
        [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (1, 0, "user", "hi")],
        [(1, 1, "a", "f", ok, None), (1, 1, "a", "f", ok, None), (1, 2, "a", "f", ok, None), (1, 3, "b", "f", "{}", "a"), (1, 4, "c", "g", ok, "zz"), (1, 5, None, "f", ok, None), (2, 1, "p", "f", ok, "q"), (2, 0, "q", "f", ok, "p"), (2, 3, "r", "f", ok, "q"), (None, 1, "a", "f", ok, None)],
        [(1, 0, "a", "early"), (1, 9, "a", "late"), (1, 4, "b", "x"), (1, 4, "o", "nobody"), (1, 4, None, "null"), (2, 5, "p", "y"), (None, 2, "a", "n")],
    )
    state = {(r.conv_id, r.kind, r.call_id, r.status) for r in got}
    assert state == {
        (1, "message", None, "ok"), (None, "message", None, "ok"), (1, "call", "a", "ok"), (1, "call", "a", "repeated"), (1, "call", "b", "invalid"), (1, "call", "c", "invalid"), (1, "call", None, "no_result"),
        (2, "call", "p", "cyclic"), (2, "call", "q", "cyclic"), (2, "call", "r", "cyclic"), (None, "call", "a", "no_result"),
        (1, "result", "a", "ok"), (1, "result", "a", "repeated"), (1, "result", "b", "ok"), (1, "result", "o", "orphan"), (1, "result", None, "orphan"), (2, "result", "p", "ok"), (None, "result", "a", "orphan"),
    }
    order = [(r.kind, r.call_id) for r in got if r.conv_id == 1]
    assert order.index(("message", None)) == 0 and order.index(("call", "a")) < order.index(("result", "a")) < order.index(("call", "b")) < order.index(("result", "b"))
    first = next(r for r in got if r.kind == "call" and r.call_id == "a" and r.status == "ok")
    assert first.json == '{"role":"assistant","tool_calls":[{"function":{"arguments":{"x":1},"name":"f"},"id":"a","type":"function"}]}'


def test_empty(spark):
    assert run(spark) == []
    assert len(run(spark, results=[(1, 1, "a", "x" * 200_000)])) == 1


def test_random_chains_are_topological(spark):
    rnd = random.Random(6)
    calls, results = [], []
    for conv in range(4):
        n = 70 if conv == 0 else 12
        for i in range(n):
            after = f"c{i - 1}" if conv == 0 and i else f"c{rnd.randrange(i)}" if i and rnd.random() < 0.7 else None
            calls.append((conv, rnd.randrange(30), f"c{i}", "f", "{}", after))
            if rnd.random() < 0.8:
                results.append((conv, rnd.randrange(30), f"c{i}", "r"))
    at = {(r.conv_id, r.kind, r.call_id): i for i, r in enumerate(run(spark, (), calls, results))}
    place = {(r.conv_id, r.kind, r.call_id): (r.place, r.step) for r in run(spark, (), calls, results)}
    assert len(at) == len(calls) + len(results)
    own = {(c[0], c[2]): c for c in calls}
    got = {(r[0], r[2]): r for r in results}
    for (conv, cid), c in own.items():
        before, turns, depth = c, [c[1]], 0
        while before[5]:
            before = own[conv, before[5]]
            depth += 1
            turns += [before[1], *([got[conv, before[2]][1]] if (conv, before[2]) in got else [])]
        assert place[conv, "call", cid] == (max(turns), 1 + 2 * depth)
        if (conv, cid) in got:
            assert at[conv, "call", cid] < at[conv, "result", cid]
        if c[5]:
            assert at[conv, "call", c[5]] < at[conv, "call", cid]
            if (conv, c[5]) in got:
                assert at[conv, "result", c[5]] < at[conv, "call", cid]


def test_query_keeps_whole_texts(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/conversations.parquet").collect()
    got = op7_chat_format(spark, sf_small).collect()
    said = {(r.conv_id, r.place, r.json) for r in got if r.kind == "message"}
    assert said == {(r.conv_id, r.turn, json.dumps({"content": r.text, "role": r.role}, ensure_ascii=False, separators=(",", ":"))) for r in rows}
    assert {r.status for r in got} >= {"ok", "invalid", "no_result", "orphan"}


@pytest.mark.parametrize("schema", [{"pattern": "a"}, {"properties": {"x": {"const": 1}}}, {"items": {"exclusiveMinimum": 0}}, {"additionalProperties": {}}, {"type": "text"}])
def test_schemas_beyond_the_checks_are_refused(schema):
    with pytest.raises(ValueError):
        check_schema(schema)
    check_schema(SCHEMAS["f"])


def test_odd_arguments_keep_the_job_alive(spark):
    got = run(spark, calls=[(1, 1, "a", "f", '{"x":"\\ud800"}', None), (1, 2, "b", "f", "[" * 900 + "]" * 900, None), (1, 3, "c", "f", "[" * 150 + "]" * 150, None)])
    assert [(r.call_id, r.status, r.faults) for r in got] == [("a", "invalid", ["not JSON"]), ("b", "invalid", ["not JSON"]), ("c", "invalid", ["$: not object"])]
    assert json.loads(got[0].json)["tool_calls"][0]["function"]["arguments"] == '{"x":"\\ud800"}'


def test_a_circle_among_many_calls_takes_few_rounds(spark, monkeypatch):
    from triage_spark.llm import op7_chat_format as A

    rounds, kept = [], A.saved
    monkeypatch.setattr(A, "saved", lambda df, name: (rounds.append(name), kept(df, name))[1])
    calls = [(1, i, f"c{i}", "f", '{"x":1}', f"c{i - 1}" if i % 4 else None) for i in range(400)] + [(2, 0, "p", "f", "{}", "q"), (2, 1, "q", "f", "{}", "p"), (2, 2, "r", "f", "{}", "q")]
    got = run(spark, calls=calls)
    assert {r.call_id for r in got if r.status == "cyclic"} == set() and rounds.count("call-places") <= 4
    assert {r.call_id for r in got if r.conv_id == 2} == {"p", "q", "r"} and {r.step for r in got if r.conv_id == 1} == {1, 3, 5, 7}
