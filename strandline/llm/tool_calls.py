"""Tool calls in conversations: linked to results, ordered, validated and written as canonical JSON.

An assistant turn calls tools when its text is a JSON object with ``tool_calls``, a list of objects with
``id``, ``name`` and ``arguments`` (an object, or its JSON text). A tool turn's text is a JSON object with
``tool_call_id`` and ``content``. An argument string ``$x`` refers to the result of call ``x`` of the same
conversation. Any other text is plain content.

Canonical JSON has sorted keys, no white space, unescaped letters, and numbers in their shortest form: a float
without a fraction is written as an integer. What isn't JSON by the standard (``NaN``, numbers beyond a double,
lone surrogates) or nests deeper than ``DEEPEST`` is plain content, not a call.

Calls and results are hash-joined by conversation and call id. A call's level is 0 if it refers to no
call, else one more than the highest level it refers to; what never gets one (a cycle, or a reference to no
call) has level null. Calls of a conversation are ordered in one task if they are ``MOST_CALLS`` at most; in
longer ones, of which one may hold a third of all rows, chains are shortened by doubling and rounds of a join
raise levels until none changes.
``conv_id, level, turn, place`` is the topological order.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.store import Tables

#: Most calls of a conversation that one task puts in order.
MOST_CALLS = 50_000
#: Levels of objects and lists that a call or result may nest.
DEEPEST = 100


def canonical(value) -> str:
    """JSON with sorted keys, no white space and unescaped letters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _number(text: str):
    x = float(text)
    if math.isinf(x):
        raise ValueError("beyond a double")
    return int(x) if x.is_integer() and abs(x) < 1 << 53 else x


def _refused(text: str):
    raise ValueError(f"{text} isn't JSON")


def _loads(text: str):
    """The value of a JSON text, nested ``DEEPEST`` levels at most. Raises ValueError or RecursionError."""
    value = json.loads(text, parse_float=_number, parse_constant=_refused)
    level = [value]
    for _ in range(DEEPEST + 1):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return value
    raise ValueError("nested too deep")


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


_KINDS = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict), "number": _is_number, "integer": lambda v: _is_number(v) and (isinstance(v, int) or v.is_integer()),
}


def _same(a, b) -> bool:
    """Equality of JSON values: ``true`` is no number, numbers are equal by value, objects by their members."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _bounded(n, schema: dict, *names: str) -> bool:
    """Whether a number keeps the bounds that a schema has under ``least, most, above, below``."""
    tests = zip(names, (lambda x: n >= x, lambda x: n <= x, lambda x: n > x, lambda x: n < x))
    return all(test(schema[k]) for k, test in tests if _is_number(schema.get(k)))


def _divides(step, value) -> bool:
    """Whether a value is a multiple of a step, both as the decimals they are written as."""
    if not _is_number(step) or not 0 < step < math.inf:
        return True
    return Fraction(str(value)) % Fraction(str(step)) == 0


def _matches(pattern, text: str) -> bool:
    try:
        return re.search(pattern, text) is not None
    except (re.error, TypeError):  # no pattern that can be tested
        return True


def _check(value, schema, path: str) -> list[str]:
    """What is wrong with a value, by the path to it. What isn't a schema, or a keyword of another kind, allows all."""
    if schema is False:
        return [f"unexpected {path}"]
    if not isinstance(schema, dict) or isinstance(value, str) and value.startswith("$"):
        return []
    kinds = schema.get("type")
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
    if kinds and all(k in _KINDS for k in kinds) and not any(_KINDS[k](value) for k in kinds):
        return [f"type of {path}"]
    out = []
    if isinstance(schema.get("enum"), list) and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        out.append(f"value of {path}")
    if _is_number(value):
        if not _bounded(value, schema, "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") or not _divides(schema.get("multipleOf"), value):
            out.append(f"range of {path}")
    elif isinstance(value, str):
        if not _bounded(len(value), schema, "minLength", "maxLength"):
            out.append(f"length of {path}")
        if isinstance(schema.get("pattern"), str) and not _matches(schema["pattern"], value):
            out.append(f"pattern of {path}")
    elif isinstance(value, list):
        if not _bounded(len(value), schema, "minItems", "maxItems"):
            out.append(f"length of {path}")
        for i, x in enumerate(value):
            out += _check(x, schema.get("items"), f"{path}[{i}]")
    elif isinstance(value, dict):
        out += _members(value, schema, f"{path}.")
    return out


def _members(value: dict, schema: dict, before: str) -> list[str]:
    known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    required = schema.get("required") if isinstance(schema.get("required"), list) else []
    out = [f"missing {before}{k}" for k in required if isinstance(k, str) and k not in value]
    for k, v in sorted(value.items()):
        out += _check(v, known[k] if k in known else schema.get("additionalProperties"), before + k)
    return out


def violations(arguments, schema: dict | bool | None) -> list[str]:
    """Why arguments don't fit a JSON schema; empty if they do. Never raises, whatever the schema holds.

    Checked at every depth: ``type`` (one or several), ``enum``, ``const``, ``properties``, ``required``, ``additionalProperties``,
    ``items``, bounds of numbers and of lengths, ``multipleOf``, ``pattern``. Other keywords, and those whose value isn't of the
    kind they need, allow everything. A reference (``$x``) fits anything, as its result isn't known. Null: unknown tool.
    """
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    if schema is None:
        return ["unknown tool"]
    if not isinstance(schema, dict):
        return ["no call is allowed"] if schema is False else []
    return _members(arguments, schema, "")


def _references(value) -> set[str]:
    out, open_ = set(), [value]
    while open_:
        x = open_.pop()
        if isinstance(x, str) and x.startswith("$") and len(x) > 1:
            out.add(x[1:])
        open_ += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return out


PARSED = "row long, conv_id long, turn long, role string, text string, calls array<struct<place:int,id:string,name:string,arguments:string,problems:array<string>,refs:array<string>>>, result_id string, content string"
_CALL = pa.list_(pa.struct([("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("problems", pa.list_(pa.string())), ("refs", pa.list_(pa.string()))]))


def _parse(schemas):
    def calls_of(data):
        out = []
        for place, call in enumerate(data["tool_calls"]):
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments", {})
            if isinstance(arguments, str):
                try:
                    arguments = _loads(arguments)
                except (ValueError, RecursionError):
                    arguments = None
            name = call.get("name")
            name, own = (name if isinstance(name, str) else None), call.get("id")
            own = own if own is None or isinstance(own, str) else canonical(own)
            out.append({"place": place, "id": own, "name": name, "arguments": canonical(arguments), "problems": violations(arguments, schemas.get(name)), "refs": sorted(_references(arguments))})
        return out

    def message(role, text):
        """Calls, id of the call that is answered, content."""
        if not text or "{" not in text or role not in ("assistant", "tool"):
            return [], None, text
        try:
            data = _loads(text)
            data = data if isinstance(data, dict) else {}
            if role == "assistant" and isinstance(data.get("tool_calls"), list):
                calls, answered = calls_of(data), None
            elif role == "tool" and data.get("tool_call_id") is not None:
                calls, answered = [], data["tool_call_id"]
                answered = answered if isinstance(answered, str) else canonical(answered)
            else:
                return [], None, text
            content = data.get("content")
            content = content if content is None or isinstance(content, str) else canonical(content)
            canonical([calls, answered, content]).encode()
        except (ValueError, RecursionError):  # among them lone surrogates, which no text can hold
            return [], None, text
        return calls, answered, content

    def run(batches):
        for batch in batches:
            rows = [message(*r) for r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            calls, ids, contents = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(calls, _CALL), pa.array(ids, pa.string()), pa.array(contents, pa.string())], names=[*batch.schema.names, "calls", "result_id", "content"])

    return run


def _write(batches):
    for batch in batches:
        rows = [
            canonical({"content": r["content"], "role": r["role"], "turn": r["turn"]} | ({"tool_call_id": r["result_id"]} if r["result_id"] is not None else {}) | ({"tool_calls": [c | {"arguments": _loads(c["arguments"])} for c in r["calls"]]} if r["calls"] else {}))
            for r in batch.select(["content", "role", "turn", "result_id", "calls"]).to_pylist()
        ]
        keep = [n for n in batch.schema.names if n in ("conv_id", "turn", "role", "n_calls", "n_valid", "n_linked")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(rows, pa.string())], names=[*keep, "json"])


def _in_order(group: pa.Table) -> pa.Table:
    """Levels of one conversation's calls: those that wait for nothing first, then what waited for them."""
    refs: dict[str, set[str]] = {}
    for own, to in zip(group["id"].to_pylist(), group["refs"].to_pylist()):
        refs.setdefault(own, set()).update(to)
    waits, after, level = {k: len(v) for k, v in refs.items()}, {}, {}
    for own, to in refs.items():
        for ref in to:
            after.setdefault(ref, []).append(own)
    ready = [k for k, n in waits.items() if not n]
    for own in ready:
        level[own] = max((level[r] + 1 for r in refs[own]), default=0)
        for other in after.get(own, ()):
            waits[other] -= 1
            if not waits[other]:
                ready.append(other)
    conv = group["conv_id"][0].as_py() if len(group) else None
    return pa.table({"conv_id": pa.array([conv] * len(level), pa.int64()), "id": pa.array(list(level), pa.string()), "level": pa.array(list(level.values()), pa.int32())})


def levels(calls: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """``conv_id, id, level`` of calls ``conv_id, id, refs``; an id that occurs twice takes the union of its references."""
    tables = Tables(calls.sparkSession)
    own = tables.write(calls.filter("id is not null and conv_id is not null").select("conv_id", "id", "refs").distinct(), "calls")
    long = tables.write(own.groupBy("conv_id").count().filter(F.col("count") > most).select("conv_id"), "long")
    short = own.join(long, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_in_order, "conv_id long, id string, level int")
    done = tables.write(short, "levels")
    if not long.isEmpty():
        done = tables.write(done.unionByName(_in_rounds(own.join(long, "conv_id", "left_semi"), tables)), "levels")
    return done


def _in_rounds(own: DataFrame, tables: Tables) -> DataFrame:
    """The same for calls of any number: chains are shortened first, by doubling, then rounds raise what is left.

    A call with one reference only hangs on it. Following that reference's own, twice as far each time, it soon hangs on a
    call that has none, or several, at a known distance; one that never does hangs in a cycle. Rounds of a join then
    go from one call with several references to the next, not from call to call.
    """
    edges = tables.write(own.select("conv_id", "id", F.explode("refs").alias("ref")).distinct(), "references")
    one = edges.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("to")).filter("n = 1")
    hung = tables.write(one.select("conv_id", "id", "to", F.lit(1).cast("long").alias("away")), "hung")
    for _ in range(max(1, hung.count()).bit_length() + 1):
        ahead = hung.select("conv_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("away").alias("more"))
        met = tables.write(hung.join(ahead, ["conv_id", "to"], "left"), "met")
        if met.filter("next is not null").isEmpty():
            tables.drop(met)
            break
        farther = tables.write(met.select("conv_id", "id", F.coalesce("next", "to").alias("to"), (F.col("away") + F.coalesce("more", F.lit(0))).alias("away")), "hung")
        tables.drop(hung, met)
        hung = farther
    several = edges.join(hung.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    far = hung.select("conv_id", F.col("id").alias("ref"), "to", "away")
    base = tables.write(several.join(far, ["conv_id", "ref"], "left").select("conv_id", "id", F.coalesce("to", "ref").alias("ref"), F.coalesce("away", F.lit(0)).alias("away")), "left")
    done = tables.write(own.select("conv_id", "id").distinct().join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    while True:
        ready = base.join(done.select("conv_id", F.col("id").alias("ref"), "level"), ["conv_id", "ref"], "left")
        new = ready.groupBy("conv_id", "id").agg((F.max(F.col("level") + F.col("away")) + 1).cast("int").alias("level"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0").drop("open")
        new = tables.write(new.join(done, ["conv_id", "id"], "left_anti"), "levels")
        if new.isEmpty():
            break
        more = tables.write(done.unionByName(new), "levels")
        tables.drop(done, new)
        done = more
    ends = done.select("conv_id", F.col("id").alias("to"), "level")
    return done.unionByName(hung.join(ends, ["conv_id", "to"]).select("conv_id", "id", (F.col("level") + F.col("away")).cast("int").alias("level")))


def linked(messages: DataFrame, schemas: dict | None = None, most: int = MOST_CALLS) -> DataFrame:
    """One row per message: ``conv_id, turn, role, n_calls, n_valid, n_linked, json``.

    In ``json`` each call carries its canonical arguments, its ``problems`` (empty: valid), its ``level``
    and the ``result`` of the earliest tool turn with its id (null: none; of results in one turn, the content
    that sorts first). ``n_linked`` of a tool turn is 1 if its call exists, else 0. Null or malformed texts are
    plain content; null conversation ids link with nothing; null roles and turns are written as null; repeated
    rows are repeated, and their calls share a result. Texts of any length are parsed as a whole. Other
    columns, whatever their names, are ignored; an empty table gives no rows. ``most`` doesn't change results.
    """
    tables = Tables(messages.sparkSession)
    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    parsed = tables.write(rows.mapInArrow(_parse(schemas or {}), PARSED), "messages")
    special = parsed.filter((F.size("calls") > 0) | F.col("result_id").isNotNull())
    calls = special.select("row", "conv_id", F.explode("calls").alias("c")).select("row", "conv_id", "c.*")
    results = special.filter("result_id is not null").groupBy("conv_id", F.col("result_id").alias("id")).agg(F.min(F.struct("turn", "content")).alias("r"))
    full = calls.join(levels(calls, most), ["conv_id", "id"], "left").join(results, ["conv_id", "id"], "left")
    per_row = full.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "name", "arguments", "problems", "refs", "level", F.col("r.content").alias("result")))).alias("calls"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.size("problems") == 0).alias("n_valid"),
        F.count_if(F.col("r").isNotNull()).alias("n_linked"),
    )
    kind = per_row.schema["calls"].dataType.simpleString()
    base = parsed.drop("calls", "text")
    named = calls.select("conv_id", F.col("id").alias("result_id")).distinct().withColumn("hit", F.lit(1).cast("long"))
    answers = base.filter("result_id is not null").join(named, ["conv_id", "result_id"], "left")
    nothing, zero = F.lit(None).cast(kind).alias("calls"), F.lit(0).cast("long")
    rest = parsed.filter((F.size("calls") == 0) & F.col("result_id").isNull()).drop("calls", "text")
    columns = ["conv_id", "turn", "role", "content", "result_id", "calls", "n_calls", "n_valid", "n_linked"]
    every = (
        base.join(per_row, "row").select(columns)
        .unionByName(answers.select("conv_id", "turn", "role", "content", "result_id", nothing, zero.alias("n_calls"), zero.alias("n_valid"), F.coalesce("hit", zero).alias("n_linked")))
        .unionByName(rest.select("conv_id", "turn", "role", "content", "result_id", nothing, zero.alias("n_calls"), zero.alias("n_valid"), zero.alias("n_linked")))
    )
    return every.mapInArrow(_write, "conv_id long, turn long, role string, n_calls long, n_valid long, n_linked long, json string")
