"""Tool-call linking for chat data (operator 6).

Calls and results are hash-joined by identifier; calls are ordered topologically by the calls they depend on (chains by
pointer doubling, so a chain of a million calls takes twenty rounds); arguments are validated against the tool's schema; each linked call is serialised as canonical JSON (sorted
keys, no blanks, shortest numbers, UTF-8). Identifiers spread the work, so a very long conversation isn't one task.

Statuses: ok, no_result, unknown_tool, bad_json, invalid_arguments, missing_dependency, cycle (the first that holds,
from the last to the first of: order, arguments, result); no_call for results without a call.

Edge cases: null identifiers link with nothing: such calls get level 0, such results a row each; several results of one
call: all in `results` by place (equal places by content), their number, and the first in `result` and the JSON; results whose identifier no call
has: one row for each identifier, without JSON; repeated call identifiers are each linked; null arguments are {}; numbers
of any size are kept; text that isn't UTF-8 (lone surrogates) is bad_json; very long texts and further columns are
nothing special; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .textops import dropped, small_batches, stored, tidy

_KINDS = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """RFC 8259 text with sorted keys and no blanks; integral floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What of a JSON-schema subset value breaks: type, enum, bounds, required, properties, additionalProperties, items."""
    kinds = schema.get("type") or []
    kinds = kinds if isinstance(kinds, list) else [kinds]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    whole = number and (isinstance(value, int) or value.is_integer())
    if kinds and not any(number if k == "number" else whole if k == "integer" else isinstance(value, _KINDS[k]) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = [f"{path}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if number:
        out += [f"{path}: below minimum"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{path}: above maximum"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, str):
        out += [f"{path}: too short"] if len(value) < schema.get("minLength", 0) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


def levels(calls):
    """(call_id, level) of distinct calls with dependencies `after`: 0 without, else one more than the latest. Those that
    wait for themselves or for a call that isn't there have no row.

    Calls with one dependency point at it; pointers are doubled until they reach a call without or with several. Those
    with several are then taken in rounds, as far as all they wait for has a level.
    """
    ids = calls.filter("call_id is not null").select("call_id").distinct()
    edges = calls.filter("call_id is not null and size(after) > 0").select("call_id", F.explode(F.array_distinct("after")).alias("on")).distinct()
    edges = stored(edges, "edges")
    needs = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("needs"), F.min("on").alias("on"))
    needs = stored(needs, "needs")
    one = needs.filter("needs = 1").select("call_id", "on")
    jumps = stored(one.select("call_id", "on", F.lit(1).cast("long").alias("steps")), "jumps")
    n = jumps.count()
    for _ in range(n.bit_length()):
        ahead = jumps.select(F.col("call_id").alias("at"), F.col("on").alias("next"), F.col("steps").alias("more"))
        both = jumps.join(ahead, F.col("on") == F.col("at"), "left")
        new = stored(both.select("call_id", F.coalesce("next", "on").alias("on"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "jumps")
        dropped(jumps)
        jumps = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    done = stored(ids.join(needs, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")), "levels")
    several = needs.filter("needs > 1").select("call_id", "needs")
    over = jumps.select(F.col("call_id").alias("on"), F.col("on").alias("top"), "steps")
    waits = edges.join(several, "call_id").join(over, "on", "left").select("call_id", "needs", F.coalesce("top", "on").alias("on"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    waits = stored(waits, "waits")
    while not waits.isEmpty():
        met = waits.join(done.withColumnRenamed("call_id", "on"), "on").groupBy("call_id", "needs").agg(F.count(F.lit(1)).alias("met"), F.max(F.col("level") + F.col("steps")).alias("level"))
        new = stored(met.filter("met = needs").join(done, "call_id", "left_anti").select("call_id", "level"), "levels")
        if new.isEmpty():
            break
        done = stored(done.union(new), "levels")
    chained = jumps.join(done.withColumnRenamed("call_id", "on"), "on").select("call_id", (F.col("level") + F.col("steps")).alias("level"))
    return done.union(chained)


def link(calls, results, schemas: dict):
    """calls: call_id, name, arguments (JSON text), after (array of call ids), place. results: call_id, content, place.

    One row per call and per identifier of results without a call: call_id, name, place, level, n_results, result,
    status, errors, json, results.
    """
    small_batches(calls.sparkSession)
    calls = calls.select(F.col("call_id").cast("string"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"), F.col("place").cast("long"))
    results = results.select(F.col("call_id").cast("string"), F.struct(F.col("place").cast("long").alias("place"), F.col("content").cast("string").alias("content")).alias("r"))
    of_call = results.filter("call_id is not null").groupBy("call_id").agg(F.sort_array(F.collect_list("r")).alias("results"))
    order = levels(calls)
    waits = calls.select("call_id", F.explode("after").alias("on")).join(calls.select(F.col("call_id").alias("on"), F.lit(True).alias("there")).distinct(), "on", "left").groupBy("call_id").agg(F.max(F.col("there").isNull()).alias("lacks"))
    called = calls.withColumn("called", F.lit(True)).join(of_call, "call_id", "full_outer")
    rows = called.join(order, "call_id", "left").join(waits.filter("lacks"), "call_id", "left")
    rows = rows.withColumn("level", F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level")))
    lost = results.filter("call_id is null").select("call_id", F.array("r").alias("results"))
    rows = lost.unionByName(rows, allowMissingColumns=True)

    def check(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for x in batch.to_pylist():
                errors, status, text = [], "ok" if x["results"] else "no_result", None
                if not x["called"]:
                    for c, v in zip(out, ("no_call", ["no call" if x["call_id"] is None else f"no call {x['call_id']}"], None), strict=True):
                        c.append(v)
                    continue
                try:
                    arguments = json.loads(x["arguments"] or "{}")
                    if x["name"] not in schemas:
                        status, errors = "unknown_tool", [f"no tool {x['name']}"]
                    elif errors := violations(arguments, schemas[x["name"]]):
                        status = "invalid_arguments"
                    text = canonical({"id": x["call_id"], "name": x["name"], "arguments": arguments, "after": sorted({a for a in x["after"] if a is not None}), "result": x["results"][0]["content"] if x["results"] else None})
                    text.encode()
                except (ValueError, RecursionError) as e:
                    status, errors, text = "bad_json", [str(e)[:200]], None
                errors = [e.encode("utf-8", "replace").decode() for e in errors]
                if x["level"] is None:
                    status = "missing_dependency" if x["lacks"] else "cycle"
                for c, v in zip(out, (status, errors, text), strict=True):
                    c.append(v)
            contents = [[r["content"] for r in x or ()] for x in batch.column("results").to_pylist()]
            content = [x[0] if x else None for x in contents]
            place = [r[0]["place"] if r and not c else p for r, c, p in zip(*(batch.column(k).to_pylist() for k in ("results", "called", "place")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("call_id"), batch.column("name"), pa.array(place, pa.int64()), batch.column("level").cast(pa.int32()), pa.array([len(x) for x in contents], pa.int64()), pa.array(content, pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.string()), pa.array(contents, pa.list_(pa.string()))], ["call_id", "name", "place", "level", "n_results", "result", "status", "errors", "json", "results"])
        tidy()

    return rows.mapInArrow(check, "call_id string, name string, place long, level int, n_results long, result string, status string, errors array<string>, json string, results array<string>")


SPAN = 256
#: Tools of the turns of a conversation, as calls_of_turns makes them.
TURN_SCHEMAS = {
    "open": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "follow_up": {"type": "object", "required": ["text", "turn", "follows"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 1}, "follows": {"type": "string"}}},
}


def calls_of_turns(conversations):
    """User turns as calls, and each assistant turn as a result of the latest user turn before it in its conversation.

    A conversation's first user turn opens it; each later one depends on the one before it. The latest user turn is sought
    in spans of SPAN turns, then in the last user turns of the spans, so that a very long conversation isn't one task.
    Assistant turns that no user turn precedes are results without a call; turns without a conversation or number are calls
    and results without an identifier.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turns = conversations.filter("role in ('user', 'assistant')").select("conv_id", "turn", "text", F.floor(F.col("turn") / SPAN).alias("span"), F.when(F.col("role") == "user", F.col("turn")).alias("asked"), (F.col("role") == "assistant").alias("answers"))
    earlier = Window.partitionBy("conv_id", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    spans = turns.groupBy("conv_id", "span").agg(F.max("asked").alias("asked"))
    before = spans.withColumn("before", F.max("asked").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.filter("before is not null").select("conv_id", "span", "before")
    turns = turns.withColumn("latest", F.max("asked").over(earlier)).join(before, ["conv_id", "span"], "left").withColumn("prev", F.coalesce("latest", "before"))
    turns = stored(turns.select("conv_id", "turn", "text", "answers", "prev"), "turns")
    follows = name(F.col("prev"))
    arguments = F.when(F.col("prev").isNull(), F.to_json(F.struct("text", "turn"))).otherwise(F.to_json(F.struct("text", "turn", follows.alias("follows"))))
    calls = turns.filter("not answers").select(name(F.col("turn")).alias("call_id"), F.when(F.col("prev").isNull(), "open").otherwise("follow_up").alias("name"), arguments.alias("arguments"), F.when(F.col("prev").isNotNull(), F.array(follows)).alias("after"), F.col("turn").alias("place"))
    results = turns.filter("answers").select(follows.alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("place"))
    return calls, results
