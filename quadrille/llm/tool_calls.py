"""Chat formatting: tool calls linked with their results.

A message of the assistant whose text is a JSON object with `tool_calls` (each
with `id`, `name` and `arguments`, in place or under `function`; arguments as an
object or as JSON text) gives one event per call, and one for its `content` if
there is any. A message of role `tool` whose text is a JSON object with
`tool_call_id` gives a result. Every other message is an event as it is - or, if
turns are taken as calls, a plain message of the user is a call of the tool REPLY
and a plain message of the assistant the result of the call one turn before.

Texts are parsed once; the events are written, and all that follows reads them
there. Calls and results meet in a hash join on conversation and identifier;
only they are shuffled, and an identifier with very many events is dealt over
tasks. Events are put in topological order by a key instead of a sorted list, so
no conversation is gathered in one task: calls follow the calls they refer to
("$id" among their arguments), and a result stands after its call even
where it was recorded before it. Inside a message that is settled where it is
parsed. A call that refers to a call of a later message moves to that
message's turn, behind it; chains of such calls are settled by rounds of joins over them
alone, a level a round. Where calls wait for each other in a ring, the first of them by turn,
place and hash keeps its place, and the others follow.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import durable, spread_join

DEPTH = 512  # levels that a JSON object may nest; deeper text is plain text, on any machine
REPLY = "reply"
# The tools of plain conversations: a prompt has a character that is no space.
SCHEMAS = {
    REPLY: {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1, "pattern": r"\S"}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string", "pattern": r"^\$turn-[0-9]+$"}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}

_EVENT = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, content string, ordinal int, text_hash long, needs array<string>"
_OUT = "conv_id long, turn long, role string, kind string, call_id string, linked boolean, valid boolean, errors array<string>, at_turn long, at_step int, at_ordinal int, json string"


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _refuse(constant: str):
    raise ValueError(constant)


def _finite(number: str) -> float:
    value = float(number)
    if math.isinf(value):
        raise ValueError(number)
    return value


def _parts(value, below: int):
    """The values in a value, itself first, without recursion; ValueError where they nest deeper than below."""
    level = [value]
    while level:
        yield from level
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        below -= 1
        if level and not below:
            raise ValueError("nested too deep")


def _object(text: str | None) -> dict | None:
    """A JSON object that nests DEPTH levels at most and whose numbers and characters can be written again; None for all else."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        for _ in _parts(value, DEPTH):
            pass
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
# The words of JSON Schema that are read, and those that say nothing about validity.
_READ = "type enum const properties required additionalProperties minProperties maxProperties items minItems maxItems uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum anyOf allOf oneOf not".split()
_SAYS_NOTHING = "$schema $comment title description default examples format deprecated readOnly writeOnly".split()


def check_schema(schema, depth: int = 64) -> None:
    """ValueError for a schema with words that violations() does not read, patterns that do not compile, or too deep a nest."""
    level = [schema]
    while level:
        below = []
        for x in level:
            if isinstance(x, bool):
                continue
            if not isinstance(x, dict):
                raise ValueError(f"a schema is an object or a boolean: {x!r}")
            unread = sorted(set(x) - set(_READ) - set(_SAYS_NOTHING))
            if unread:
                raise ValueError(f"these words of a schema are not read: {', '.join(unread)}")
            if "pattern" in x:
                re.compile(x["pattern"])
            below += x.get("properties", {}).values()
            below += [x[w] for w in ("additionalProperties", "items", "not") if w in x]
            below += [y for w in ("anyOf", "allOf", "oneOf") for y in x.get(w, [])]
        level, depth = below, depth - 1
        if level and not depth:
            raise ValueError("a schema nests too deep")


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def _alike(value):
    """Values that JSON Schema takes for equal have one form: 1.0 is 1."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_alike(x) for x in value]
    return {k: _alike(x) for k, x in value.items()} if isinstance(value, dict) else value


def violations(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What of a checked schema does not hold. Goes as deep as the schema does, not the value."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"]
    out = []
    if "enum" in schema or "const" in schema:
        own = canonical(_alike(value))
        if any(own not in same for same in ([canonical(_alike(x)) for x in schema[w]] if w == "enum" else [canonical(_alike(schema[w]))] for w in ("enum", "const") if w in schema)):
            out.append(f"{at}: not an allowed value")
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            out += violations(value[k], known.get(k, other), f"{at}.{k}")
    for low, high, size in (("minItems", "maxItems", list), ("minLength", "maxLength", str), ("minProperties", "maxProperties", dict)):
        if isinstance(value, size) and not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            out.append(f"{at}: length {len(value)} out of bounds")
    if isinstance(value, list):
        if schema.get("uniqueItems") and len({canonical(_alike(x)) for x in value}) < len(value):
            out.append(f"{at}: repeated items")
        for n, x in enumerate(value if "items" in schema else ()):
            out += violations(x, schema["items"], f"{at}[{n}]")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: not of the pattern")
    if _is(value, "number"):
        inside = schema.get("minimum", value) <= value <= schema.get("maximum", value)
        if not inside or value <= schema.get("exclusiveMinimum", value - 1) or value >= schema.get("exclusiveMaximum", value + 1):
            out.append(f"{at}: out of bounds")
    for word, enough in (("allOf", len(schema.get("allOf", []))), ("anyOf", 1), ("oneOf", 1)):
        if word in schema:
            held = sum(not violations(value, x, at) for x in schema[word])
            if held < enough or word == "oneOf" and held > 1:
                out.append(f"{at}: {word} does not hold")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: not allowed")
    return out


def _references(value) -> set[str]:
    return {x[1:] for x in _parts(value, DEPTH + 2) if isinstance(x, str) and x.startswith("$")}


def _ordered(calls: list[tuple]) -> list[tuple]:
    """Calls (id, name, arguments text, references) after those they refer to; else as given, and a cycle is cut where it closes."""
    places: dict[str, list[int]] = {}
    for n, c in enumerate(calls):
        places.setdefault(c[0], []).append(n)
    needs = [[m for r in sorted(c[3]) if r is not None for m in places.get(r, ()) if m != n] for n, c in enumerate(calls)]
    seen, out = [False] * len(calls), []
    for first in range(len(calls)):
        stack = [] if seen[first] else [(first, iter(needs[first]))]
        seen[first] = True
        while stack:
            n, rest = stack[-1]
            below = next((m for m in rest if not seen[m]), None)
            if below is None:
                out.append(calls[n])
                stack.pop()
            else:
                seen[below] = True
                stack.append((below, iter(needs[below])))
    return out


def _events(role: str | None, text: str | None, turn: int | None = None) -> list[tuple]:
    """(kind, call id, name, arguments, content, ids referred to) of one message; with a turn, plain ones of user and assistant are calls and results."""
    found = _object(text) if role in ("assistant", "tool") else None
    if found and role == "tool" and isinstance(found.get("tool_call_id"), str):
        content = found.get("content")
        return [("result", found["tool_call_id"], None, None, content if isinstance(content, str) or content is None else canonical(content), None)]
    if found and role == "assistant" and isinstance(found.get("tool_calls"), list) and found["tool_calls"]:
        calls = []
        for c in found["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            inner = c["function"] if isinstance(c.get("function"), dict) else c
            arguments = inner.get("arguments")
            parsed = _object(arguments) if isinstance(arguments, str) else arguments
            name, own = inner.get("name"), c.get("id")
            calls.append((own if isinstance(own, str) else None, name if isinstance(name, str) else None, canonical(parsed if parsed is not None or arguments is None else arguments), _references(parsed)))
        content = found.get("content")
        first = [("message", None, None, None, content if isinstance(content, str) else canonical(content), None)] if content else []
        return first + [("call", i, n, a, None, sorted(needs) or None) for i, n, a, needs in _ordered(calls)]
    if turn is not None and role == "user":
        arguments = {"prompt": text, "turn": turn} | ({"after": f"$turn-{turn - 2}"} if turn >= 2 else {})
        return [("call", f"turn-{turn}", REPLY, canonical(arguments), None, None)]  # what it refers to came before
    if turn is not None and role == "assistant":
        return [("result", f"turn-{turn - 1}", None, None, text, None)]
    return [("message", None, None, None, text, None)]


def _moved(events: DataFrame, ends: DataFrame) -> DataFrame | None:
    """m_conv, m_call, m_turn, m_depth of calls that wait, at first or at second hand, for a call of a later message: the turn they go to, and how many calls deep they wait there. None if no call does.

    A round settles the calls all of whose needs are settled, so rounds are as many as
    the longest chain of calls concerned; if none is left but rings, the first call of each conversation's is settled where it is.
    """
    here = F.struct("turn", "ordinal", "text_hash")
    asks = events.where("kind = 'call' AND needs IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL").select("conv_id", here.alias("call"), F.explode("needs").alias("call_id"))
    all_needs = asks.join(ends.where("first.turn IS NOT NULL").select("conv_id", "call_id", F.col("first").alias("need")), ["conv_id", "call_id"]).where("need <> call").select("conv_id", "call", "need").distinct()
    forward = durable(all_needs.where("need.turn > call.turn"))
    if forward.isEmpty():
        return None
    # nothing moves beyond the last turn that is waited for
    last = forward.groupBy("conv_id").agg(F.max("need.turn").alias("last"))
    needs = durable(all_needs.join(last, "conv_id").where("call.turn <= last").drop("last"))
    concerned = new = durable(forward.select("conv_id", "call").distinct())
    while not new.isEmpty():
        behind = needs.join(new.select("conv_id", F.col("call").alias("need")), ["conv_id", "need"], "left_semi").select("conv_id", "call").distinct()
        new = durable(behind.join(concerned, ["conv_id", "call"], "left_anti"))
        concerned = durable(concerned.unionByName(new))
    waits = durable(needs.join(concerned, ["conv_id", "call"], "left_semi"))
    others = waits.select("conv_id", F.col("need").alias("call")).distinct().join(concerned, ["conv_id", "call"], "left_anti")
    settled = durable(others.select("conv_id", "call", F.col("call.turn").alias("at"), F.lit(0).alias("depth")))
    while not waits.isEmpty():
        known = waits.join(settled.withColumnRenamed("call", "need"), ["conv_id", "need"], "left")
        own = F.struct(F.col("call.turn").alias("at"), F.lit(0).alias("depth"))
        later = (F.col("at") > F.col("call.turn")) | (F.col("at") == F.col("call.turn")) & (F.col("depth") > 0)
        place = F.max(F.when(later, F.struct("at", (F.col("depth") + 1).alias("depth"))).otherwise(own))
        fresh = known.groupBy("conv_id", "call").agg(F.count("*").alias("n"), F.count("at").alias("k"), place.alias("place")).where("n = k")
        fresh = durable(fresh.select("conv_id", "call", F.col("place.at").alias("at"), F.col("place.depth").alias("depth")))
        if fresh.isEmpty():
            first = waits.groupBy("conv_id").agg(F.min("call").alias("call"))
            fresh = durable(first.select("conv_id", "call", F.col("call.turn").alias("at"), F.lit(0).alias("depth")))
        settled = durable(settled.unionByName(fresh))
        waits = durable(waits.join(fresh, ["conv_id", "call"], "left_anti"))
    gone = settled.where("at <> call.turn OR depth > 0")
    return gone.select(F.col("conv_id").alias("m_conv"), F.col("call").alias("m_call"), F.col("at").alias("m_turn"), F.col("depth").alias("m_depth"))


def link_tool_calls(conversations: DataFrame, schemas: dict[str, dict] | None = None, turns_are_calls: bool = False) -> DataFrame:
    """One row per event: conv_id, turn, role, kind, call_id, linked, valid, errors, at_turn, at_step, at_ordinal, json.

    Sorting by conv_id, at_turn, at_step, at_ordinal and turn gives the
    topological order, over messages too; json is the event in canonical form. linked: a call has a
    result, a result a call, of the same conversation; the first call of an
    identifier, by turn, takes its results. A call is valid if its tool is in
    schemas, its arguments are an object, and they hold to its schema; events of
    other kinds are valid, but for a result without a call. Where an identifier
    is missing or null nothing is linked. Null texts and roles, text that is no
    such JSON (numbers beyond a double and nests of more than DEPTH levels
    included), null ids and repeated rows come through as messages; an empty
    table gives no rows; other columns are not read. A schema with words that are
    not read is refused with ValueError.

    turns_are_calls: a plain message of the user is a call of REPLY by the id
    turn-<turn>, with the arguments prompt (the text), turn, and after ("$" and
    the id two turns before, from the third turn on); a plain message of the
    assistant is the result of the call turn-<turn - 1>. Rows without a turn stay
    messages. SCHEMAS has the schema for this.
    """
    known = dict(schemas or {})
    for x in known.values():
        check_schema(x)

    def parse(batches):
        for batch in batches:
            out = []
            for conv, turn, role, text, h in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "text_hash")), strict=True):
                out += [(conv, turn, role, *event, n, h, needs) for n, (*event, needs) in enumerate(_events(role, text, turn if turns_are_calls else None))]
            columns = list(zip(*out, strict=True)) or [()] * 11
            types = (pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _EVENT.split(", ")])

    narrow = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    events = durable(narrow.mapInArrow(parse, _EVENT))
    on = ["conv_id", "call_id"]
    here = F.struct("turn", "ordinal", "text_hash")
    linkable = events.where("kind <> 'message'")
    ends = durable(linkable.groupBy(*on).agg(F.min(F.when(F.col("kind") == "call", here)).alias("first"), F.bool_or(F.col("kind") == "result").alias("answered"), F.count("*").alias("n")))
    met = spread_join(linkable.drop("needs"), ends.select(*on, "first", "answered"), on, ends, "left")
    moved = _moved(events, ends)
    is_call = F.col("kind") == "call"
    linked = F.when(is_call, F.col("answered") & (F.col("first") == here)).otherwise(F.col("first").isNotNull())
    met = met.withColumn("linked", F.coalesce(linked, F.lit(False)))
    if moved is None:
        met = met.withColumns({"_turn": F.when(is_call, F.col("turn")).otherwise(F.col("first.turn")), "_depth": F.lit(0)})
    else:
        # where a call has gone, or the call of a result; calls are told apart by place and text
        call = F.when(is_call, here).otherwise(F.col("first"))
        found = met.withColumn("_call", call).join(moved, F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("_call") == F.col("m_call")), "left")
        met = found.withColumns({"_turn": F.coalesce("m_turn", "_call.turn"), "_depth": F.coalesce("m_depth", F.lit(0))}).drop("m_conv", "m_call", "m_turn", "m_depth", "_call")
    early = ~is_call & F.col("linked") & (F.col("turn") <= F.col("_turn"))
    placed = (
        met.withColumn("at_turn", F.when(early | is_call, F.col("_turn")).otherwise(F.col("turn")))
        .withColumn("at_step", F.when(is_call, 1 + 2 * F.col("_depth")).when(early, 2 + 2 * F.col("_depth")).otherwise(F.lit(0)).cast("int"))
        .withColumn("at_ordinal", F.when(is_call, F.col("ordinal")).when(early, F.col("first.ordinal")).otherwise(F.lit(0)))
    )
    rest = events.where("kind = 'message'").withColumn("linked", F.lit(False)).withColumn("at_turn", F.col("turn")).withColumn("at_step", F.lit(0)).withColumn("at_ordinal", F.col("ordinal"))
    columns = ["conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "content", "linked", "at_turn", "at_step", "at_ordinal"]

    def write(batches):
        for batch in batches:
            rows = batch.to_pylist()
            valid, errors, texts = [], [], []
            for r in rows:
                wrong = []
                event = {"conv_id": r["conv_id"], "kind": r["kind"], "role": r["role"], "turn": r["turn"], "content": r["content"]}
                if r["kind"] == "call":
                    arguments = json.loads(r["arguments"])
                    event |= {"call_id": r["call_id"], "name": r["name"], "arguments": arguments, "linked": r["linked"]}
                    if r["name"] not in known:
                        wrong.append("unknown tool")
                    elif not isinstance(arguments, dict):
                        wrong.append("arguments are no object")
                    else:
                        wrong = violations(arguments, known[r["name"]])
                elif r["kind"] == "result":
                    event |= {"call_id": r["call_id"], "linked": r["linked"]}
                    wrong = [] if r["linked"] else ["no such call"]
                valid.append(not wrong)
                errors.append(wrong)
                texts.append(canonical({k: v for k, v in event.items() if v is not None} | ({"errors": wrong} if wrong else {})))
            keep = [batch.column(c) for c in ("conv_id", "turn", "role", "kind", "call_id", "linked")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), *(batch.column(c) for c in ("at_turn", "at_step", "at_ordinal")), pa.array(texts, pa.string())], names=[x.split()[0] for x in _OUT.split(", ")])

    return rest.select(columns).unionByName(placed.select(columns)).mapInArrow(write, _OUT)
