"""Links tool calls to their results and writes them as canonical JSON, in dependency order.

Calls and results meet in an equi-join on (conversation, identifier), after each side is reduced to
the earliest row of an identifier. Order: a call's key starts as its own time; a call that depends on one of
a key not below its time takes that key one level higher, in rounds of joins until nothing moves. As
calls mostly depend on earlier ones, a round or two do. Sorting by key is then a topological order.
Positions are counted in two steps, within stretches of time and over the stretches' sizes, so that
no conversation has to fit into a task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

_STRETCH = 256
#: Rounds before cycles are looked for.
_LOOK = 8


def canonical(value) -> str:
    """JSON with sorted names (by UTF-16 units), no white space, shortest numbers (RFC 8785)."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("JSON has no such number")
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
        mantissa, _, exponent = repr(value).partition("e")
        if not exponent:
            return mantissa
        power = int(exponent)
        if -7 < power < 0:
            digits = mantissa.lstrip("-").replace(".", "")
            return "-" * (value < 0) + "0." + "0" * (-power - 1) + digits
        return f"{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"
    return json.dumps(value, ensure_ascii=False)


_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return not isinstance(value, bool) and isinstance(value, (int, float))
    return isinstance(value, _KINDS[kind])


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON Schema (type, enum, bounds, lengths, properties, required, items) value breaks."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = []
    if "enum" in schema and not any(value == e and type(value) is type(e) for e in schema["enum"]):
        out.append(f"{at}: enum")
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", math.inf))) if bad]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", -math.inf)), ("maximum", value > schema.get("maximum", math.inf))) if bad]
    if isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", math.inf))) if bad]
        if "items" in schema:
            out += [e for i, v in enumerate(value) for e in schema_errors(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: additional" for k in sorted(value) if k not in known]
        out += [e for k in sorted(value) if k in known for e in schema_errors(value[k], known[k], f"{at}.{k}")]
    return out


def _behind_cycles(edges: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, call_id of all calls on a cycle or depending on one: what is left after calls without open
    dependencies, and calls that nothing open depends on, are peeled off until nothing moves."""
    open_, before = edges.select("conv_id", "call_id", "on_id"), -1
    while True:
        down = open_.join(open_.select("conv_id", F.col("call_id").alias("on_id")).distinct(), ["conv_id", "on_id"], "left_semi")
        open_ = work.table(down.join(down.select("conv_id", F.col("on_id").alias("call_id")).distinct(), ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", "on_id"), "peeled")
        left = open_.count()
        if left in (0, before):
            break
        before = left
    stuck = spread = work.table(open_.select("conv_id", "call_id").distinct(), "stuck")
    while not spread.isEmpty():
        more = edges.join(spread.select("conv_id", F.col("call_id").alias("on_id")), ["conv_id", "on_id"], "left_semi").select("conv_id", "call_id").distinct()
        spread = work.table(more.join(stuck, ["conv_id", "call_id"], "left_anti"), "behind")
        stuck = work.table(stuck.unionByName(spread), "stuck")
    return stuck


def ordered(calls: DataFrame, deps: DataFrame, work: Workspace) -> DataFrame:
    """calls (conv_id, call_id, seq) with lift, level and position from 0 in a topological order.

    deps: conv_id, call_id, on_id. Unknown identifiers and self-references don't count. Calls on a cycle, and
    those that depend on one, have no place in any order and get no row. Rounds go on until nothing moves: a
    chain of n calls that each depend on a later one takes n of them. Cycles are looked for only where
    ``_LOOK`` rounds didn't settle everything."""
    keys = ["conv_id", "call_id"]
    now = work.table(calls.select(*keys, "seq", F.col("seq").alias("lift"), F.lit(0).cast("long").alias("level")), "keys")
    edges = work.table(deps.where("call_id <> on_id").distinct().join(calls.select(*keys), keys, "left_semi").join(calls.select("conv_id", F.col("call_id").alias("on_id")), ["conv_id", "on_id"], "left_semi"), "deps")
    rounds = 0
    while True:
        on = now.select("conv_id", F.col("call_id").alias("on_id"), F.struct("lift", (F.col("level") + 1).alias("level")).alias("k"))
        pushed = edges.join(on, ["conv_id", "on_id"]).groupBy(*keys).agg(F.max("k").alias("k"))
        raised = now.join(pushed, keys, "left").withColumn("up", F.coalesce((F.col("k.lift") > F.col("lift")) | ((F.col("k.lift") == F.col("lift")) & (F.col("k.level") > F.col("level"))), F.lit(False)))
        moved = work.table(raised.select(*keys, "seq", F.when(F.col("up"), F.col("k.lift")).otherwise(F.col("lift")).alias("lift"), F.when(F.col("up"), F.col("k.level")).otherwise(F.col("level")).alias("level"), "up"), "round")
        work.drop(now)
        now = moved.select(*keys, "seq", "lift", "level")
        if moved.where("up").isEmpty():
            break
        rounds += 1
        if rounds == _LOOK:
            stuck = _behind_cycles(edges, work)
            now = work.table(now.join(stuck, keys, "left_anti"), "loose")
            edges = work.table(edges.join(stuck, keys, "left_anti"), "deps")
    placed = now.withColumn("stretch", F.floor(F.col("lift") / _STRETCH))
    inner = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy("lift", "level", "seq", "call_id")) - 1
    sizes = placed.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = placed.withColumn("inner", inner).join(sizes.withColumn("before", before).drop("size"), ["conv_id", "stretch"])
    return done.select(*keys, (F.col("before") + F.col("inner")).cast("long").alias("position"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], work: Workspace) -> DataFrame:
    """calls: conv_id, call_id, seq, name, arguments (JSON), after (array of call ids); results: conv_id,
    call_id, seq, content. Returns a row for each call and each result without one:

    conv_id, call_id, status (linked, unanswered, orphan), position (null for orphans and cycles), valid
    (null for orphans), errors, n_calls and n_results of the identifier, json.

    Rows with a null conversation or identifier can't be linked and give no row. Of several calls or results
    of an identifier the one with the least (seq, content) counts. Null or unparsable arguments, and names
    without a schema, are errors."""
    keys = ["conv_id", "call_id"]
    known = lambda df: df.where("conv_id is not null and call_id is not null")
    one = known(calls).groupBy(*keys).agg(F.min(F.struct("seq", "name", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("n_calls")).select(*keys, "c.*", "n_calls")
    one = work.table(one, "calls")
    answer = known(results).groupBy(*keys).agg(F.min(F.struct("seq", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")).select(*keys, F.col("r.content").alias("content"), "n_results")
    answer = work.table(answer, "results")
    deps = one.select(*keys, F.explode("after").alias("on_id")).where("on_id is not null")
    places = ordered(one.select(*keys, F.coalesce("seq", F.lit(0)).cast("long").alias("seq")), deps, work)
    joined = one.join(answer, keys, "left").join(places, keys, "left").drop("seq")
    orphans = answer.join(one, keys, "left_anti").select(*keys, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("after"), F.lit(0).cast("long").alias("n_calls"), "content", "n_results", F.lit(None).cast("long").alias("position"))
    rows = joined.select(*orphans.columns).unionByName(orphans)
    shown = "conv_id long, call_id string, status string, position long, valid boolean, errors array<string>, n_calls long, n_results long, json string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_line(r, schemas) for r in batch.to_pylist()]
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in shown.split(", ")])

    return rows.mapInArrow(write, shown)


def _line(r: dict, schemas: dict[str, dict]) -> tuple:
    status = "orphan" if not r["n_calls"] else "linked" if r["n_results"] else "unanswered"
    errors, arguments = [], None
    if status != "orphan":
        try:
            arguments = json.loads(r["arguments"])
            errors = schema_errors(arguments, schemas[r["name"]])
        except KeyError:
            errors = ["name: no schema"]
        except (TypeError, ValueError):
            errors = ["$: JSON"]
    record = {"id": r["call_id"], "result": r["content"]}
    if status != "orphan":
        record |= {"name": r["name"], "arguments": arguments, "after": sorted({a for a in r["after"] or [] if a is not None})}
    return (r["conv_id"], r["call_id"], status, r["position"], None if status == "orphan" else not errors, errors, r["n_calls"], r["n_results"] or 0, canonical(record))


#: What a turn of a conversation must look like to be asked of the tool that answers it.
TURN_SCHEMA = {"type": "object", "additionalProperties": False, "required": ["question", "turn"], "properties": {"question": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls of the tool ``answer``, each after the user turn two turns earlier; assistant
    turns as results of the turn before them. Rows of another role, and those with a null turn, are neither
    and give no row; of repeated turns one counts (see link_calls). Other columns aren't read."""
    name = lambda back: F.concat_ws(":", "conv_id", (F.col("turn") - back).cast("string"))
    fields = F.to_json(F.struct(F.col("text").alias("question"), F.col("turn").alias("turn")))
    users = conversations.where("role = 'user' and turn is not null")
    calls = users.select(F.col("conv_id").cast("long").alias("conv_id"), name(0).alias("call_id"), F.col("turn").cast("long").alias("seq"), F.lit("answer").alias("name"), fields.alias("arguments"), F.array(name(2)).alias("after"))
    results = conversations.where("role = 'assistant' and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), name(1).alias("call_id"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("content"))
    return calls, results


def call_report(conversations: DataFrame) -> DataFrame:
    """Per call or orphan result: conv_id, call_id, status, position, valid, n_errors, json_sha256."""
    work = Workspace(conversations.sparkSession, "calls")
    linked = link_calls(*conversation_calls(conversations), {"answer": TURN_SCHEMA}, work)
    return linked.select("conv_id", "call_id", "status", "position", "valid", F.size("errors").cast("long").alias("n_errors"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))
