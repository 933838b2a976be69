"""Tool-call linking for chats: calls and results joined by identifier, ordered, validated and written as canonical JSON.

A call names the calls that it waits for. Those of its own message are sorted within the message, which is one row; those of earlier
messages stand before it anyway; one that waits for a later or an unknown call is an error. So a conversation's topological order is
(turn, place), and no conversation, however long, is gathered: calls, results and what is waited for meet in hash joins by
(conversation, identifier). Every message, with its calls, and every linked call become a line of canonical JSON.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table

CALL = "struct<id:string,name:string,arguments:string,after:array<string>>"
#: Arguments may be nested so deep; a message holds them three levels further down.
DEEPEST = 500
KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, characters unescaped, and whole floats as integers. Numbers that JSON has no form for raise."""

    def plain(x):
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def depth(value) -> int:
    """How many objects and lists stand within each other, counted without recursion."""
    deepest, level = 0, [value]
    while level := [x for x in level if isinstance(x, (dict, list))]:
        deepest += 1
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def parsed(text: str | None) -> tuple[object, str | None, str | None]:
    """(value, canonical form, error) of a call's arguments; null and empty text are no arguments.

    What isn't JSON (NaN and Infinity, numbers out of range, unpaired surrogates among it) or is nested deeper than DEEPEST is an error.
    """
    try:
        value = json.loads(text or "{}", parse_constant=no_constant)
        if depth(value) > DEEPEST:
            return None, None, "$: nested too deeply"
        form = canonical(value)
        form.encode()
    except ValueError:
        return None, None, "$: not JSON"
    except RecursionError:
        return None, None, "$: nested too deeply"
    return value, form, None


def problems(value, schema: dict | bool, path: str = "$") -> list[str]:
    """What of a value a JSON schema forbids. Keywords read: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength.

    A schema may be true or false; a type that JSON schemas don't have is reported as such.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool)

    def is_(kind: str) -> bool:
        if kind in ("number", "integer"):
            return number and (kind == "number" or value == math.floor(value))
        return isinstance(value, KINDS[kind])

    odd = [k for k in kinds if k not in KINDS and k not in ("number", "integer")]
    if odd:
        return [f"{path}: the schema has an unknown type {odd[0]}"]
    if kinds and not any(map(is_, kinds)):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not one of the values allowed")
    if isinstance(value, dict):
        fields, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in fields:
                out += problems(value[k], fields[k], f"{path}.{k}")
            elif rest is False:
                out.append(f"{path}.{k}: unknown")
            else:
                out += problems(value[k], rest, f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{path}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{path}: length out of bounds")
    elif number and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{path}: out of bounds")
    return out


def topological(calls: list[dict]) -> tuple[list[int], set[int]]:
    """Places of a message's calls so that each comes after those it waits for, the earliest first among the free; and those in or behind a cycle, at the end.

    Waiting for a call of another message orders nothing here. Of calls with one identifier the first is meant; null identifiers name none.
    """
    place: dict = {}
    for i, c in enumerate(calls):
        if c["id"] is not None:
            place.setdefault(c["id"], i)
    waits = [{place[a] for a in c["after"] or [] if a in place} for c in calls]
    behind: dict[int, list[int]] = defaultdict(list)
    for i, others in enumerate(waits):
        for j in others:
            behind[j].append(i)
    left = list(map(len, waits))
    free, order = [i for i, n in enumerate(left) if not n], []
    heapq.heapify(free)
    while free:
        order.append(heapq.heappop(free))
        for i in behind[order[-1]]:
            left[i] -= 1
            if not left[i]:
                heapq.heappush(free, i)
    stuck = [i for i, n in enumerate(left) if n]
    return order + stuck, set(stuck)


ROWS = "conv_id long, turn long, place int, call_id string, name string, arguments string, after array<string>, errors array<string>, json string"


def messages_and_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows ROWS of messages (conv_id, turn, role, content, calls): one for each message, without a place, and one for each of its calls.

    Calls are ordered within their message, their arguments validated and canonical; errors is empty for a sound call. A message's json
    has its role, its content and its calls in order. schemas, of bounded number, are the tools' argument schemas. Messages without
    calls, or with null ones among them, are messages all the same.
    """

    def make():
        def step(batch: dict) -> dict:
            out: dict = {n: [] for n in (x.split()[0] for x in ROWS.split(", "))}

            def put(*values):
                for column, x in zip(out.values(), values, strict=True):
                    column.append(x)

            for conv, turn, role, content, calls in zip(*(batch[n] for n in ("conv_id", "turn", "role", "content", "calls")), strict=True):
                calls = [c for c in calls or [] if c is not None]
                order, stuck = topological(calls)
                listed = []
                for place, i in enumerate(order):
                    c, errors = calls[i], ["waits in a circle"] if i in stuck else []
                    value, form, error = parsed(c["arguments"])
                    if error:
                        errors.append(error)
                    elif c["name"] not in schemas:
                        errors.append("unknown tool")
                    else:
                        errors += problems(value, schemas[c["name"]])
                    listed.append({"id": c["id"], "name": c["name"], "arguments": value})
                    put(conv, turn, place, c["id"], c["name"], form, c["after"], errors, None)
                message = {"role": role, "content": content} | ({"tool_calls": listed} if listed else {})
                put(conv, turn, None, None, None, None, None, [], canonical(message))
            return out

        return step

    rows = messages.select("conv_id", "turn", "role", "content", F.col("calls").cast(f"array<{CALL}>").alias("calls"))
    return arrow_map(rows, make, ROWS)


def with_waits(rows: DataFrame) -> DataFrame:
    """Adds to the errors of calls those of what they wait for beyond their message: a call that nobody makes, or makes later."""
    waits = rows.where("place is not null").select("conv_id", "turn", "place", F.explode("after").alias("wanted")).where("wanted is not null")
    made = rows.where("call_id is not null and conv_id is not null").groupBy("conv_id", F.col("call_id").alias("wanted")).agg(F.min("turn").alias("made"))
    met = waits.join(made, ["conv_id", "wanted"], "left")
    wrong = met.where("made is null or made > turn").select("conv_id", "turn", "place", F.concat(F.when(F.col("made").isNull(), "waits for an unknown call: ").otherwise("waits for a later call: "), "wanted").alias("e"))
    named = wrong.groupBy("conv_id", "turn", "place").agg(F.array_sort(F.collect_set("e")).alias("e"))
    here = [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("conv_id", "turn", "place")]
    joined = rows.alias("r").join(named.alias("n"), here[0] & here[1] & here[2], "left")
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns if c not in ("errors", "after")], F.concat("r.errors", F.coalesce("n.e", F.array().cast("array<string>"))).alias("errors"))


def link(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Calls joined with results (conv_id, call_id, turn, content): status linked, unanswered, early (the result stands before the call) or orphan; of messages, message.

    Of several results of a call the first by turn, then by content, counts; of several calls of one identifier in a conversation each
    gets it. Null identifiers link with nothing. Equal keys of many rows are pre-aggregated on the results' side, so a hot key meets one row.
    """
    first = results.where("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"))
    made = rows.withColumn("made", F.lit(True))
    joined = made.join(first, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("made").isNull(), "orphan").when(F.col("place").isNull(), "message").when(F.col("r").isNull(), "unanswered").when(F.col("r.result_turn") < F.col("turn"), "early").otherwise("linked")
    return joined.select("conv_id", "call_id", "turn", "place", "name", "arguments", "errors", "json", status.alias("status"), F.col("r.result_turn").alias("result_turn"), F.col("r.content").alias("content"))


def serialised(linked: DataFrame) -> DataFrame:
    """Fills json: a canonical record of each call and its result. Orphans have their result alone; messages keep what they have."""

    def make():
        def step(batch: dict) -> dict:
            out = []
            for k, name, args, status, content, json_ in zip(*(batch[n] for n in ("call_id", "name", "arguments", "status", "content", "json")), strict=True):
                record = {"id": k, "status": status, "result": content}
                if status != "orphan":
                    record |= {"name": name, "arguments": None if args is None else json.loads(args)}
                out.append(json_ if status == "message" else canonical(record))
            return batch | {"json": out}

        return step

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.schema)
    return arrow_map(linked, make, kept)


def formatted(messages: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Messages, calls and results as lines of canonical JSON: rows (conv_id, turn, place, call_id, name, arguments, errors, status, result_turn, content, json).

    Repeated rows give repeated lines, empty tables none; columns beyond those named are not read.
    """
    return serialised(link(with_waits(messages_and_calls(messages, schemas)), results))


#: The tools that op8's chats call.
TOOLS = {
    "measure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "answer": {"type": "object", "required": ["question", "words"], "properties": {"question": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 64}}},
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats of plain turns as messages with calls, and results: a user's turn calls measure, and answer, which waits for it.

    The user's turn itself gives measure's result, its number of words. An assistant's or a system's turn is the result of the answer
    call that the turn before it would make; where no user spoke then, it is an orphan. Turns without a role are neither. Null texts are
    empty, and an empty question fails its schema; results without a conversation or a turn can't be named and are left out.
    """
    text = F.coalesce("text", F.lit(""))
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    ask = F.to_json(F.struct(text.alias("question"), n_words.alias("words")))
    call = lambda name, args, after: F.struct(F.concat(F.lit(name[0]), F.col("turn")).alias("id"), F.lit(name).alias("name"), args.alias("arguments"), after.alias("after"))
    first = F.array(F.concat(F.lit("m"), F.col("turn")))
    calls = F.array(call("answer", ask, first), call("measure", F.to_json(F.struct(text.alias("text"))), F.array().cast(T.ArrayType(T.StringType()))))
    user = turns.where("role = 'user'")
    messages = turns.select("conv_id", "turn", "role", text.alias("content"), F.when(F.col("role") == "user", calls).alias("calls"))
    measured = user.select("conv_id", F.concat(F.lit("m"), F.col("turn")).alias("call_id"), "turn", n_words.cast("string").alias("content"))
    answers = turns.where("role <> 'user'").select("conv_id", F.concat(F.lit("a"), F.col("turn") - 1).alias("call_id"), "turn", text.alias("content"))
    return messages, measured.union(answers)


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, results = from_turns(table(spark, sf_dir, "conversations"))
    out = formatted(messages, results, TOOLS)
    return out.select("conv_id", "turn", "place", "call_id", "name", "status", F.array_join("errors", "; ").alias("errors"), "result_turn", "json")
