"""Chat formatting: tool calls linked with their results.

Calls and results meet in a hash join on conversation and identifier. References between calls (an argument that is
{"$ref": identifier}) give an order in which every call follows what it refers to; arguments are checked against the
tool's schema; each call is written as canonical JSON: keys sorted, no spaces, no escapes but the needed ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, map_texts
from tallyfold.operators.graph import longest

_TYPES: dict[str, Callable[[Any], bool]] = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
}


def problem(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, enum, required, properties, additionalProperties, items, bounds), or None.

    A reference to another call's result stands for a value of any type.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None if isinstance(value["$ref"], str) else f"{at}: reference is not a string"
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the allowed values"
    if _TYPES["number"](value):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            return f"{at}: out of bounds"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{at}: length out of bounds"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        missing = [k for k in schema.get("required", []) if k not in value]
        if missing:
            return f"{at}: {missing[0]} is missing"
        for k in sorted(value):
            if k in known:
                found = problem(value[k], known[k], f"{at}.{k}")
                if found:
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}: {k} is not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found = problem(x, schema["items"], f"{at}[{i}]")
            if found:
                return found
    return None


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _finite(x: str):
    raise ValueError(f"{x} is not JSON")


def parse(text: str) -> Any:
    """JSON; keys must be unique and numbers finite."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_finite)


def canonical(value: Any) -> str:
    """One text for equal values: sorted keys, no spaces, whole floats as integers."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("number out of range")
            return int(x) if x.is_integer() and abs(x) < 1e15 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def references(value: Any) -> list[str]:
    """Identifiers that a value refers to, sorted, each once."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                found.add(x["$ref"])
            else:
                todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(found)


def checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, name, canonical, refs, problem) of (conv_id, call_id, turn, name, arguments).

    problem is null for valid arguments. Null or malformed arguments and unknown tools are problems; canonical is then null.
    """
    packed = calls.select("conv_id", "call_id", "turn", "name", F.to_json(F.struct("name", "arguments")).alias("call"))

    def make() -> Callable[[list], dict]:
        def one(text: str) -> tuple[str | None, list[str], str | None]:
            call = json.loads(text)
            name, arguments = call.get("name"), call.get("arguments")
            if arguments is None:
                return None, [], "no arguments"
            try:
                value = parse(arguments)
                form, refs = canonical(value), references(value)
            except (ValueError, RecursionError) as e:
                return None, [], f"not JSON: {str(e)[:80]}"
            if name not in schemas:
                return form, refs, "unknown tool"
            return form, refs, problem(value, schemas[name])

        def work(texts: list) -> dict:
            got = [one(t) for t in texts]
            return {
                "canonical": pa.array([x[0] for x in got], pa.string()),
                "refs": pa.array([x[1] for x in got], pa.list_(pa.string())),
                "problem": pa.array([x[2] for x in got], pa.string()),
            }

        return work

    return map_texts(packed, make, "canonical string, refs array<string>, problem string", "conv_id", "call", keep=["call_id", "turn", "name"])


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that no circle of references reaches: 0, or one more than the highest it refers to. Nothing bounds a chain's length."""
    return longest(calls, edges, ("conv_id",), "call_id", "ref").select("conv_id", "call_id", F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls (conv_id, call_id, turn, name, arguments) with results (conv_id, call_id, turn, content), in order.

    Columns: conv_id, call_id, name, turn, level, n_calls, n_results, status, record. Of calls, and of results, with one
    identifier the first counts (smallest turn, then content), the others are told by n_calls and n_results. status:
    ok, no_result, orphan_result (no such call), invalid (its problem is in the record), missing_reference (to a call
    that is not there), cyclic (it refers to itself in the end) or no_id, which a row without an identifier gets, as
    it can be linked with nothing. Other columns are not looked at; empty tables give no rows.
    """
    keys = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(F.col("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"))
    results = results.select(F.col("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))
    first = F.min(F.struct("turn", "name", "arguments")).alias("c")
    one = calls.filter(named).groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n_calls")).select(*keys, "n_calls", "c.*")
    known = cut(checked(one, schemas).join(one.select(*keys, "n_calls"), keys))
    back = results.filter(named).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")).select(*keys, F.col("r.turn").alias("result_turn"), "r.content", "n_results")

    edges = cut(known.select(*keys, F.explode("refs").alias("ref")))
    there = known.select("conv_id", F.col("call_id").alias("ref"))
    missing = edges.join(there, ["conv_id", "ref"], "left_anti").select(*keys).distinct().withColumn("missing", F.lit(True))
    order = levels(known, edges.join(there, ["conv_id", "ref"], "left_semi"))

    d = known.join(order, keys, "left").join(missing, keys, "left").hint("shuffle_hash").join(back, keys, "full_outer")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan_result")
        .when(F.col("problem").isNotNull(), "invalid")
        .when(F.col("missing"), "missing_reference")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("n_results").isNull(), "no_result")
        .otherwise("ok")
    )
    d = d.select(*keys, "name", F.coalesce("turn", "result_turn").alias("turn"), "level", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), "canonical", "content", "problem")
    lone = lambda t, name: t.filter(~named).select(*keys, name.alias("name"), "turn", F.lit(None).cast("int").alias("level"), F.lit(0 if t is results else 1).cast("long").alias("n_calls"), F.lit(1 if t is results else 0).cast("long").alias("n_results"), F.lit("no_id").alias("status"), F.lit(None).cast("string").alias("canonical"), (F.col("content") if t is results else F.lit(None).cast("string")).alias("content"), F.lit(None).cast("string").alias("problem"))
    d = d.unionByName(lone(calls, F.col("name"))).unionByName(lone(results, F.lit(None).cast("string")))
    # Keys in alphabetical order; to_json leaves out what is null, and quotes strings as JSON does.
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":|\}$", "")
    fields = [
        F.concat(F.lit('"arguments":'), F.col("canonical")),
        F.concat(F.lit('"id":'), F.when(F.col("call_id").isNotNull(), quoted("call_id"))),
        F.concat(F.lit('"name":'), F.when(F.col("name").isNotNull(), quoted("name"))),
        F.concat(F.lit('"problem":'), F.when(F.col("problem").isNotNull(), quoted("problem"))),
        F.concat(F.lit('"result":'), F.when(F.col("content").isNotNull(), quoted("content"))),
    ]
    record = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return d.select(*keys, "name", "turn", "level", "n_calls", "n_results", "status", record.alias("record"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from (conv_id, turn, role, text): a user's turn is a call, the assistant's next turn its result.

    The k-th call of a conversation refers to its call k // 2, so that references form a tree. Rows that repeat
    conversation, turn and role are passed on, for link to count.
    """
    turns = conversations.filter(F.col("role").isin("user", "assistant"))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    users = turns.filter("role = 'user'").select("conv_id", "turn", "text", F.floor(F.col("turn") / 2).cast("long").alias("k"))
    name = F.element_at(F.array(F.lit("search"), F.lit("summarise"), F.lit("translate")), (F.pmod("k", F.lit(3)) + 1).cast("int"))
    at = F.floor(F.col("k") / 2) * 2 + F.col("turn") % 2
    refers = F.when((F.col("k") > 0) & (at >= 0), F.struct(call_id(at.cast("long")).alias("$ref")))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("limit"), refers.alias("context")))
    calls = users.select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"))
    results = turns.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


#: Schemas of the tools that turns_as_calls names.
SCHEMAS = {
    name: {
        "type": "object",
        "required": ["query", "limit"],
        "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}, "context": {"type": "object"}},
    }
    for name in ("search", "summarise", "translate")
}
