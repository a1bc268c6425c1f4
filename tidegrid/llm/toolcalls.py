"""Operator 3: conversations with tool calls as canonical JSON, each call linked to its result.

A message may hold blocks ``<tool_call>{"id", "name", "arguments"}</tool_call>`` and ``<tool_result>{"id", "content"}</tool_result>``.
Calls and results are joined by conversation and identifier, ordered so that each stands after what it needs, checked
against the schemas of the tools, and written with sorted keys. An argument ``{"$result": id}`` needs that call's result.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

_BLOCK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)

#: Schemas of the tools that the query knows; a parameter of :func:`link_calls`.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


_CHECKED = {"type", "enum", "minimum", "maximum", "properties", "required", "additionalProperties", "items"}
_SAID = {"title", "description", "default", "examples", "$schema", "$comment"}  # say nothing about what is valid


def checked(schema: object, at: str = "$") -> dict:
    """A schema as :func:`faults` reads it, its type as a list. A keyword that isn't checked, an unknown type or a part of the wrong kind is a ValueError, before any row is read."""
    if not isinstance(schema, dict):
        raise ValueError(f"the schema at {at} is not an object")
    if odd := set(schema) - _CHECKED - _SAID:
        raise ValueError(f"the schema at {at} has keywords that aren't checked: {', '.join(sorted(map(str, odd)))}")
    out = {k: v for k, v in schema.items() if k in _CHECKED}
    if "type" in out:
        kinds = [out["type"]] if isinstance(out["type"], str) else out["type"]
        if not isinstance(kinds, list) or not kinds or not all(isinstance(k, str) and k in _KINDS for k in kinds):
            raise ValueError(f"the schema at {at} has the type {schema['type']!r}; known are {', '.join(_KINDS)}")
        out["type"] = kinds
    for key, kind in (("enum", list), ("required", list), ("properties", dict), ("additionalProperties", bool)):
        if key in out and not isinstance(out[key], kind):
            raise ValueError(f"{key} of the schema at {at} is not a {kind.__name__}")
    for key in ("minimum", "maximum"):
        if key in out and (not isinstance(out[key], (int, float)) or isinstance(out[key], bool)):
            raise ValueError(f"{key} of the schema at {at} is not a number")
    if "properties" in out:
        out["properties"] = {str(k): checked(v, f"{at}.{k}") for k, v in out["properties"].items()}
    if "items" in out:
        out["items"] = checked(out["items"], f"{at}[]")
    return out


def _is(x: object, kind: str) -> bool:
    if isinstance(x, bool):
        return kind == "boolean"
    return isinstance(x, _KINDS[kind]) or kind == "integer" and isinstance(x, float) and x.is_integer()


def canonical(x: object) -> str:
    """JSON with sorted keys, no spaces, and characters as they are; a lone surrogate becomes a question mark."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8", "replace").decode()


def faults(x: object, schema: dict, at: str = "$") -> list[str]:
    """What in ``x`` breaks a :func:`checked` schema (type, enum, minimum, maximum, properties, required, additionalProperties, items). A whole number is an integer, however written.

    An object with the only key $result stands for any value."""
    if isinstance(x, dict) and set(x) == {"$result"}:
        return []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(x, kind) for kind in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and x not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        if x < schema.get("minimum", x):
            out.append(f"{at}: under the minimum")
        if x > schema.get("maximum", x):
            out.append(f"{at}: over the maximum")
    if isinstance(x, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in x]
        for k in sorted(x):
            if k in known:
                out += faults(x[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: {k} is unknown")
    if isinstance(x, list) and "items" in schema:
        for i, v in enumerate(x):
            out += faults(v, schema["items"], f"{at}[{i}]")
    return out


def _needs(x: object) -> set[str]:
    if isinstance(x, dict):
        if set(x) == {"$result"} and isinstance(x["$result"], str):
            return {x["$result"]}
        return set().union(*map(_needs, x.values()))
    return set().union(*map(_needs, x)) if isinstance(x, list) else set()


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_PART = pa.struct([("part", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("needs", pa.list_(pa.string())), ("faults", pa.list_(pa.string())), ("json", pa.string())])


def parser(schemas: dict[str, dict]):
    """Arrow function of role and text: the message itself (part 0) and its blocks, each as canonical JSON."""
    schemas = {name: checked(schema, name) for name, schema in schemas.items()}

    @F.arrow_udf("array<struct<part: int, kind: string, id: string, needs: array<string>, faults: array<string>, json: string>>")
    def parse(roles: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for role, text in zip(roles.to_pylist(), texts):
            text = text.as_py()
            blocks = list(_BLOCK.finditer(text)) if text is not None and "<tool_" in text else []
            body = _BLOCK.sub("", text) if blocks else text
            parts = [{"part": 0, "kind": "message", "id": None, "needs": [], "faults": [], "json": canonical({"content": body, "role": role})}]
            for k, m in enumerate(blocks, 1):
                kind = m[1]
                try:
                    made = json.loads(m[2], parse_constant=_refuse)
                    if not isinstance(made, dict):
                        raise ValueError("not an object")
                    wrong, needs = [], []
                    name = made.get("id") if isinstance(made.get("id"), str) else None
                    if name is None:
                        wrong.append("no id")
                    if kind == "call":
                        schema = schemas.get(made["name"]) if isinstance(made.get("name"), str) else None
                        wrong += ["unknown tool"] if schema is None else faults(made.get("arguments"), schema)
                        needs = sorted(_needs(made.get("arguments")))
                    text_of = canonical(made)
                except (ValueError, RecursionError, OverflowError):  # also numbers beyond all bounds and nesting beyond the stack
                    name, wrong, needs, text_of = None, ["malformed"], [], canonical({"malformed": m[2]})
                clean = lambda x: None if x is None else x.encode("utf-8", "replace").decode()
                parts.append({"part": k, "kind": kind, "id": clean(name), "needs": [clean(x) for x in needs], "faults": [clean(x) for x in wrong], "json": text_of})
            out.append(parts)
        return pa.array(out, pa.list_(_PART))

    return parse


def _jumps(singles: DataFrame) -> DataFrame:
    """Of calls that need one result each (conv_id, id, to, steps, m): how far down a chain of such calls reaches.

    By pointer doubling, in as many rounds as the logarithm of the longest chain: ``to`` is then a call that needs none or several, ``steps``
    the calls passed, ``m`` the latest turn on the way. Calls that run into a cycle are left out."""
    jumps = cut(singles, "calls-jumps")
    for _ in range(jumps.count().bit_length() + 1):  # a chain without a cycle is no longer than there are calls
        on = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.to") == F.col("b.id"))
        further = jumps.alias("a").join(jumps.alias("b"), on, "left")
        m, steps = F.greatest("a.m", "b.m"), F.col("a.steps") + F.coalesce("b.steps", F.lit(0))
        jumps = cut(further.select("a.conv_id", "a.id", F.coalesce("b.to", "a.to").alias("to"), steps.alias("steps"), m.alias("m"), F.col("b.id").isNotNull().alias("moved")), "calls-jumps")
        if jumps.where("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    ends = jumps.select("conv_id", F.col("id").alias("to"))
    return cut(jumps.join(ends, ["conv_id", "to"], "left_anti").select("conv_id", "id", "to", "steps", "m"), "calls-jumps")


def _levels(calls: DataFrame, has_result: DataFrame) -> DataFrame:
    """conv_id, id, level, at of each call that can be ordered.

    ``calls``: conv_id, id, turn, needs. A call is one level above the results that it needs and not before them; a result is
    one level above its call. Chains of calls that need one result each are passed at once (:func:`_jumps`); what is left, calls that need
    several, is settled round by round, in as many rounds as the longest chain has of these. Calls in a cycle, and those that
    need them, are never settled; needs without a call and a result are passed over."""
    known = has_result.select("conv_id", F.col("id").alias("need"), F.col("turn").alias("came"))
    edges = calls.select("conv_id", "id", "turn", F.explode("needs").alias("need")).join(known, ["conv_id", "need"])
    edges = cut(edges.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "id"))), "calls-needs")
    settled = cut(calls.join(edges.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).cast("long").alias("level"), F.col("turn").alias("at")), "calls-settled")
    if edges.isEmpty():
        return settled
    jumps = _jumps(edges.where("n = 1").select("conv_id", "id", F.col("need").alias("to"), F.lit(1).cast("long").alias("steps"), F.greatest("turn", "came").alias("m")))
    hop = jumps.select("conv_id", F.col("id").alias("need"), "to", "steps", "m")
    many = edges.where("n > 1").join(hop, ["conv_id", "need"], "left")
    left = cut(many.select("conv_id", "id", "turn", F.coalesce("to", "need").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.greatest("came", "m").alias("m")), "calls-left")
    rounds = 0
    while not left.isEmpty():
        done = settled.select("conv_id", F.col("id").alias("to"), F.col("level").alias("l"), F.col("at").alias("t"))
        state = left.join(done, ["conv_id", "to"], "left").groupBy("conv_id", "id").agg(F.count_if(F.col("l").isNull()).alias("open"), F.max(F.col("l") + 2 * F.col("steps")).alias("level"), F.max(F.greatest("turn", "m", "t")).alias("at"))
        ready = cut(state.where("open = 0").select("conv_id", "id", "level", "at"), "calls-ready")
        if ready.isEmpty():
            break
        settled, rounds = settled.union(ready), rounds + 1
        settled = cut(settled, "calls-settled") if rounds % 8 == 0 else settled
        left = cut(left.join(ready, ["conv_id", "id"], "left_anti").select(*left.columns), "calls-left")
    done = settled.select("conv_id", F.col("id").alias("to"), F.col("level").alias("l"), F.col("at").alias("t"))
    reached = jumps.join(done, ["conv_id", "to"]).select("conv_id", "id", (F.col("l") + 2 * F.col("steps")).alias("level"), F.greatest("m", "t").alias("at"))
    return settled.union(reached)


def link_calls(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """Messages (conv_id, turn, role, text) to their parts: one row for each message and for each block in it.

    Returns conv_id, turn, part (0: the message without its blocks, then its blocks), kind (message, call, result), id,
    at and level (ordering a conversation by at, level, turn, part puts each part after what it needs), linked
    (turn of the result of a call, or of the call of a result), faults (array: malformed, no id, unknown tool, breaches of
    the schema, duplicate, no call, no result, cycle), json (canonical).

    Of calls, and of results, that share a conversation and an id the first by turn and part counts, the others are
    duplicates and not linked. Parts of unlinked kind and calls in a cycle keep their own turn and level 0. Conversations
    are never gathered, so one may hold any share of the rows. A block that is no JSON object, holds a number out of range or is
    nested beyond the stack is malformed, and its text is kept. Texts of any length are read whole. A null text has null
    content; rows without conv_id, turn or role are kept with nulls, and link to nothing where conv_id or turn is null; repeated
    rows give repeated parts; an empty table gives no rows. Other columns are ignored.
    """
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(parser(schemas)("role", "text")).alias("p")).select("conv_id", "turn", "p.*")
    parts = cut(base, "calls-parts")
    plain = parts.where("kind = 'message'").select("conv_id", "turn", "part", "kind", "id", F.col("turn").alias("at"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("linked"), "faults", "json")
    blocks = parts.where("kind != 'message'")
    if blocks.isEmpty():
        return plain
    named = blocks.where("id is not null and conv_id is not null and turn is not null")
    first = cut(named.groupBy("conv_id", "kind", "id").agg(F.min(F.struct("turn", "part")).alias("f")), "calls-first")
    calls = first.where("kind = 'call'").select("conv_id", "id", F.col("f.turn").alias("turn"), F.col("f.part").alias("part"))
    results = first.where("kind = 'result'").select("conv_id", "id", F.col("f.turn").alias("turn"))
    wanted = named.where("kind = 'call'").join(calls, ["conv_id", "id", "turn", "part"]).groupBy("conv_id", "id", "turn").agg(F.first("needs").alias("needs"))
    pairs = calls.join(results.select("conv_id", "id", F.col("turn").alias("came")), ["conv_id", "id"])
    level = cut(_levels(wanted, pairs.select("conv_id", "id", F.col("came").alias("turn"))), "calls-levels")
    known = calls.select("conv_id", "id", F.col("turn").alias("call_turn")).join(results.select("conv_id", "id", F.col("turn").alias("result_turn")), ["conv_id", "id"], "full")
    known = cut(known.join(level.select("conv_id", "id", F.col("level").alias("l"), F.col("at").alias("t")), ["conv_id", "id"], "left"), "calls-known")
    rows = blocks.join(first, ["conv_id", "kind", "id"], "left").join(known, ["conv_id", "id"], "left")
    call = F.col("kind") == "call"
    again = F.col("f").isNotNull() & ((F.col("f.turn") != F.col("turn")) | (F.col("f.part") != F.col("part")))
    lone = F.col("f").isNotNull() & ~again & F.when(call, F.col("result_turn").isNull()).otherwise(F.col("call_turn").isNull())
    ring = F.col("f").isNotNull() & ~again & F.col("call_turn").isNotNull() & F.col("l").isNull()
    more = F.filter(F.array(F.when(again, F.lit("duplicate")), F.when(lone & call, F.lit("no result")), F.when(lone & ~call, F.lit("no call")), F.when(ring, F.lit("cycle"))), lambda x: x.isNotNull())
    ok = F.col("f").isNotNull() & ~again & F.col("l").isNotNull()
    at = F.when(ok, F.greatest("turn", "t")).otherwise(F.col("turn"))
    steps = F.when(ok, F.col("l") + F.when(call, 0).otherwise(1)).otherwise(0)
    linked = F.when(~again & ~lone, F.when(call, F.col("result_turn")).otherwise(F.col("call_turn")))
    done = rows.select("conv_id", "turn", "part", "kind", "id", at.alias("at"), steps.cast("int").alias("level"), linked.alias("linked"), F.concat("faults", more).alias("faults"), "json")
    return plain.union(done)


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_calls(table(spark, sf_dir, "conversations"))
    return out.withColumn("faults", F.array_join("faults", "; "))


#: The tables given hold no blocks, and of messages without blocks SQL can write the JSON.
OP3_SQL = """
select conv_id, turn, cast(0 as integer) part, 'message' kind, cast(null as varchar) id, turn "at", cast(0 as integer) "level",
       cast(null as bigint) linked, '' faults,
       '{"content":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"role":' || coalesce(cast(to_json(role) as varchar), 'null') || '}' json
from conversations
"""
