"""Chat formatting: tool-call linking, topological order, argument checks and canonical JSON.

Input are three tables: messages (conv_id, turn, role, text), calls
(conv_id, turn, call_id, name, arguments as JSON text, after: the call whose
result it needs) and results (conv_id, turn, call_id, content).  Output is one row
for each of their distinct rows, with the message as one line of canonical JSON.

Calls and results meet in hash joins by (conv_id, call_id).  The order is a
topological one of: messages by turn; a call after the message of its turn and
after the result of the call it names in ``after``; a result after its call.  A
call's place is the latest turn among its own and those of all calls
and results before it in its chain, then its depth in the chain; both are
found by pointer doubling over the calls (every round a join by identifier doubles
how far each call sees, so a chain of n calls takes log2(n) rounds).  A
conversation is never gathered: its rows are in order when sorted by
(place, step, call_id), so one conversation may hold any share of the table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import saved, text_steps

KINDS = {
    "string": str,
    "integer": int,
    "number": (int, float),
    "boolean": bool,
    "array": list,
    "object": dict,
    "null": type(None),
}


def is_kind(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, KINDS[kind])


#: Schema keywords that ``faults`` knows, and levels of nested JSON that are read and written.
KNOWN = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "items", "properties", "required", "additionalProperties", "title", "description"}
MOST_LEVELS = 200


def check_schema(schema: dict, at: str = "$") -> None:
    """Raises if the schema asks for what ``faults`` cannot judge."""
    odd = sorted(schema.keys() - KNOWN)
    kinds = schema.get("type", [])
    if odd or not isinstance(schema.get("additionalProperties", True), bool) or any(k not in KINDS for k in ([kinds] if isinstance(kinds, str) else kinds)):
        raise ValueError(f"schema at {at} is not supported: {', '.join(odd) or 'type or additionalProperties'}")
    for k, part in schema.get("properties", {}).items():
        check_schema(part, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where and how ``value`` breaks the schema (type, enum, required, properties, additionalProperties, items and the bounds of numbers and lengths)."""
    kinds = schema.get("type")
    if kinds and not any(is_kind(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", math.inf):
            found.append(f"{at}: longer than {schema['maxLength']}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += faults(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                found += faults(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    return found


def _plain_numbers(value, level: int = 0):
    if level > MOST_LEVELS:
        raise ValueError("nested too deep")
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    if isinstance(value, dict):
        return {k: _plain_numbers(v, level + 1) for k, v in value.items()}
    return [_plain_numbers(v, level + 1) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    """JSON with keys in UTF-16 order, no spaces, whole floats as integers; equal values give equal strings."""

    def ordered(v):
        if isinstance(v, dict):
            return {k: ordered(v[k]) for k in sorted(v, key=lambda s: s.encode("utf-16-be", "surrogatepass"))}
        return [ordered(x) for x in v] if isinstance(v, list) else v

    return json.dumps(ordered(_plain_numbers(value)), separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def checked(name: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """The parsed arguments (the text itself if they are not JSON) and what is wrong with them."""
    if name not in schemas:
        found = ["unknown tool"]
    else:
        found = []
    try:
        value = _plain_numbers(json.loads(text or "", object_pairs_hook=_unique), 10)
        # What cannot be written (a lone surrogate) is not JSON either.
        canonical(value).encode()
    except (ValueError, RecursionError):
        return text or "", [*found, "not JSON"]
    return value, found or faults(value, schemas[name])


def line(kind: str, role: str | None, text: str | None, call_id: str | None, name: str | None, schemas: dict[str, dict]) -> tuple[str, list[str]]:
    """The canonical message and the faults of its arguments."""
    if kind == "message":
        return canonical({"role": role or "", "content": text or ""}), []
    if kind == "result":
        return canonical({"role": "tool", "tool_call_id": call_id or "", "content": text or ""}), []
    args, found = checked(name, text, schemas)
    call = {"id": call_id or "", "type": "function", "function": {"name": name or "", "arguments": args}}
    return canonical({"role": "assistant", "tool_calls": [call]}), found


def _first(df: DataFrame, *order: str) -> DataFrame:
    """Adds is_first: whether a row is the least by ``order`` of its (conv_id, call_id); an aggregate, so a hot identifier is no hot task."""
    least = df.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("least"))
    least = least.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"), "least")
    on = F.col("conv_id").eqNullSafe(F.col("f_conv")) & F.col("call_id").eqNullSafe(F.col("f_call"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("least")[c]) for c in order])
    return df.join(least.hint("shuffle_hash"), on, "left").withColumn("is_first", same).drop("f_conv", "f_call", "least")


def _places(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, seen (latest turn of the chain before it, null without one), depth, cyclic; calls: linked first calls with ``own`` (latest turn of call and result) and after."""
    have = calls.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), F.col("own").alias("p_own"))
    met = calls.join(have.hint("shuffle_hash"), (F.col("conv_id") == F.col("p_conv")) & (F.col("after") == F.col("p_call")), "left")
    state = saved(met.select("conv_id", "call_id", F.col("p_call").alias("up"), F.col("p_own").alias("seen"), F.when(F.col("p_call").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "call-places")
    done, state = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    n, reach = state.count(), 1
    # Calls without a step left are set aside.  On a chain that ends, a call with 2 * reach steps to go has ``reach`` calls behind it that point on as
    # well; so if no more than that many do, what still points on after the next round stands on a circle or behind one.
    while n:
        last_round = n <= reach
        far = done.unionAll(state).select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), F.col("up").alias("p_up"), F.col("seen").alias("p_seen"), F.col("depth").alias("p_depth"))
        on = (F.col("conv_id") == F.col("p_conv")) & (F.col("up") == F.col("p_call"))
        step = state.join(far.hint("shuffle_hash"), on, "left")
        state = saved(step.select("conv_id", "call_id", F.col("p_up").alias("up"), F.greatest("seen", "p_seen").alias("seen"), (F.col("depth") + F.coalesce("p_depth", F.lit(0))).alias("depth")), "call-places")
        done, state = done.unionAll(state.filter("up IS NULL")), state.filter("up IS NOT NULL")
        n, reach = state.count(), reach * 2
        if last_round:
            break
    state = done.unionAll(state)
    cyclic = F.col("up").isNotNull()
    return state.select("conv_id", "call_id", F.when(~cyclic, F.col("seen")).alias("seen"), F.when(cyclic, 0).otherwise(F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, place, step, kind, call_id, status, faults, json; in order by (conv_id, place, step, call_id).

    status of a message: ok.  Of a call: invalid (faults says why), else cyclic
    (its chain of ``after`` runs in a circle; it keeps its own turn), else
    no_result, else ok; repeated if an earlier call has its id.  Of a result: ok,
    orphan (no call has its id) or repeated (an earlier result has its id).  ``after`` without such a call has no effect.

    Rows equal in all their columns count once; of several calls or results with
    one id the first by turn, then text, is linked.  Null turns come first, null texts are
    empty, a null id links to nothing, null conv_ids are one conversation
    without links.  Only the named columns are read.  Empty tables are allowed.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn")
    conv = F.col("conv_id").cast("long").alias("conv_id")
    said = messages.select(conv, turn, "role", "text").distinct()
    asked = calls.select(conv, turn, "call_id", "name", F.col("arguments").alias("text"), "after").distinct()
    given = results.select(conv, turn, "call_id", F.col("content").alias("text")).distinct()
    asked = saved(_first(asked, "turn", "name", "text", "after"), "chat-calls")
    given = saved(_first(given, "turn", "text"), "chat-results")

    best = given.filter("is_first").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("turn").alias("r_turn"))
    linked = asked.filter("is_first").join(best.hint("shuffle_hash"), (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "left")
    linked = saved(linked.select("conv_id", "call_id", "turn", "after", F.greatest("turn", "r_turn").alias("own"), F.col("r_turn").isNotNull().alias("answered")), "chat-links")
    placed = _places(linked.filter("conv_id IS NOT NULL AND call_id IS NOT NULL"))
    facts = linked.select(F.col("conv_id").alias("q_conv"), F.col("call_id").alias("q_call"), F.col("turn").alias("q_turn"), "answered").join(
        placed.withColumnsRenamed({"conv_id": "q_conv", "call_id": "q_call"}).hint("shuffle_hash"), ["q_conv", "q_call"]
    )
    facts = saved(facts.select("q_conv", "q_call", F.greatest("q_turn", "seen").alias("q_place"), "depth", "cyclic", "answered"), "chat-places")
    on = (F.col("conv_id") == F.col("q_conv")) & (F.col("call_id") == F.col("q_call"))

    def rows(df: DataFrame, kind: str, place: Column, step: Column, status: Column) -> DataFrame:
        extra = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("call_id", "role", "name")}
        return df.select("conv_id", place.cast("long").alias("place"), step.cast("long").alias("step"), F.lit(kind).alias("kind"), extra["call_id"].alias("call_id"), status.alias("status"), extra["role"].alias("role"), extra["name"].alias("name"), "text")

    with_call = asked.join(facts.hint("shuffle_hash"), on, "left")
    mine = F.col("is_first") & F.col("q_call").isNotNull()
    call_status = F.when(~F.col("is_first"), "repeated").when(F.coalesce("cyclic", F.lit(False)), "cyclic").when(~F.coalesce("answered", F.lit(False)), "no_result").otherwise("ok")
    call_rows = rows(with_call, "call", F.when(mine, F.col("q_place")).otherwise(F.col("turn")), F.when(mine, 1 + 2 * F.col("depth")).otherwise(1), call_status)
    with_result = given.join(facts.hint("shuffle_hash"), on, "left")
    met = F.col("q_call").isNotNull()
    result_status = F.when(~met, "orphan").when(~F.col("is_first"), "repeated").otherwise("ok")
    # Of a repeated result too: its call comes first.
    result_rows = rows(with_result, "result", F.when(met, F.greatest("turn", "q_place")).otherwise(F.col("turn")), F.when(met, 2 + 2 * F.col("depth")).otherwise(2), result_status)
    everything = rows(said, "message", F.col("turn"), F.lit(0), F.lit("ok")).unionByName(call_rows).unionByName(result_rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            col = {n: b.column(n).to_pylist() for n in ("kind", "role", "text", "call_id", "name", "status")}
            done = [line(k, r, t, c, n, schemas) for k, r, t, c, n in zip(col["kind"], col["role"], col["text"], col["call_id"], col["name"])]
            status = ["invalid" if f and s != "repeated" else s for (_, f), s in zip(done, col["status"])]
            new = [pa.array(status, pa.string()), pa.array([f for _, f in done], pa.list_(pa.string())), pa.array([t for t, _ in done], pa.string())]
            names = ["conv_id", "place", "step", "kind", "call_id"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + new, [*names, "status", "faults", "json"])

    return everything.mapInArrow(write, "conv_id long, place long, step long, kind string, call_id string, status string, faults array<string>, json string")


# The query's tools and, as ``conversations`` has no tool calls, the ones derived from its turns.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 5}, "limit": {"type": "integer", "minimum": 1, "maximum": 10}}},
    "calculate": {"type": "object", "required": ["a", "b", "op"], "properties": {"a": {"type": "number"}, "b": {"type": "number"}, "op": {"enum": ["add", "sub", "mul"]}}},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "lines": {"type": "array", "items": {"type": "integer"}}}},
}


def tool_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A call in each assistant turn, on its own words, and the results of most, some late, early or under a wrong id."""
    turns = conversations.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    mark = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.col("turn"), F.lit(12))
    args = (
        F.when(mark % 4 == 0, F.to_json(F.struct((F.col("n") % 13).alias("limit"), F.substring("text", 1, 40).alias("query"))))
        .when(mark % 4 == 1, F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ("add", "sub", "mul", "pow"))), (F.col("n") % 4 + 1).cast("int")).alias("op"), F.col("turn").alias("a"), (F.col("n") / 4).alias("b"))))
        .when(mark % 4 == 2, F.to_json(F.struct(F.when(F.col("n") % 5 > 0, F.concat(F.lit("https://example.com/"), F.col("n"))).alias("url"), F.array("n", "turn").alias("lines"))))
        .otherwise(F.lit("{}"))
    )
    args = F.when(F.col("n") % 11 == 0, F.substring(args, 1, 9)).otherwise(args)
    name = F.element_at(F.array(*map(F.lit, ("search", "calculate", "fetch", "forget"))), (mark % 4 + 1).cast("int"))
    call_id = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    calls = turns.select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), args.alias("arguments"), F.when(mark % 3 > 0, F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string"))).alias("after"))
    answer = F.when(F.col("n") % 17 == 0, F.concat(call_id, F.lit("?"))).otherwise(call_id)
    results = turns.filter("n % 7 > 0").select("conv_id", (F.col("turn") + F.col("n") % 5 - 1).alias("turn"), answer.alias("call_id"), F.reverse("text").alias("content"))
    return calls, results


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_chats(talks, *tool_turns(talks), SCHEMAS)
