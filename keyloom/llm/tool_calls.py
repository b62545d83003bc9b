"""Tool-call linking: calls meet their results, are ordered by dependency, checked against schemas, and serialised.

Calls and results are hash-joined by conversation and call identifier. A call may follow another (``after``); its level
is the number of calls before it along that chain, found by pointer doubling (each round every call learns its
ancestor twice as far away, so a chain of n calls takes about log2 n rounds), and (level, place) is a topological
order. Calls in a cycle have no level. Rows stay one to a call, so a conversation of any length is spread over tasks.

Defined cases: a call without result is ``unanswered``, a result without call an ``orphan``; of several results of a call
the one at the earliest place counts (ties: the smaller content) and the others are ``duplicate`` rows if asked for
(``further``); each result without call is a row; of repeated call identifiers each is linked; an
``after`` that names no call counts as none; null arguments, or arguments that are not JSON objects, are invalid, and
so are tools without a schema; a null conversation is one of its own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut

#: The tool that plain turns are read as calls of.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["role", "text", "turn"],
        "additionalProperties": False,
        "properties": {"role": {"type": "string", "enum": ["system", "user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What makes a value differ from a schema (type, enum, bounds, lengths, required and further properties, items)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: under {schema['minimum']}")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: over {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: longer than {schema['maxLength']}")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not known")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _strict(text: str | None):
    def bad(x: str):
        raise ValueError(x)

    return json.loads(text, parse_constant=bad) if text is not None else None


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in ``conversations(conv_id, turn, role, text)``.

    A user or system turn is a call of ``reply`` named by its conversation and turn, after the call two turns before; an
    assistant (or tool) turn is the result of the turn before it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = lambda t: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(t.cast("string"), F.lit("")))
    asked = F.coalesce(F.col("role"), F.lit("user")).isin("user", "system")
    args = F.to_json(F.struct("role", "text", "turn"))
    calls = rows.where(asked).select("conv_id", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), args.alias("arguments"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("after"), F.col("turn").alias("place"))
    results = rows.where(~asked).select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("place"))
    return calls, results


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of each distinct call; null within or behind a cycle."""
    ids = calls.groupBy("conv_id", "call_id").agg(F.min("after").alias("after"))
    known = ids.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2"))
    same = lambda a: (a.conv_id.eqNullSafe(F.col("c2"))) & (a.after == F.col("i2"))
    at = cut(ids.join(known, same(ids), "left").select("conv_id", "call_id", F.col("i2").alias("after"), F.when(F.col("i2").isNull(), 0).otherwise(1).cast("long").alias("level")))
    span, most = 1, at.count()
    while span <= most and not at.where("after is not null").isEmpty():
        up = at.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2"), F.col("after").alias("after2"), F.col("level").alias("level2"))
        at = cut(at.join(up, same(at), "left").select("conv_id", "call_id", F.col("after2").alias("after"), (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level")))
        span *= 2
    return at.select("conv_id", "call_id", F.when(F.col("after").isNull(), F.col("level")).alias("level"))


def _finish(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, said, texts = [], [], []
            for conv, call, tool, args, content, after, level, status in zip(*(b.column(c).to_pylist() for c in ("conv_id", "call_id", "tool", "arguments", "content", "after", "level", "status")), strict=True):
                wrong, value = [], None
                if status not in ("orphan", "duplicate"):
                    try:
                        value = _strict(args)
                        wrong = problems(value, {"type": "object"} | schemas[tool]) if tool in schemas else ["unknown tool"]
                    except (ValueError, RecursionError):
                        value, wrong = args, ["not JSON"]
                valid.append(None if status in ("orphan", "duplicate") else not wrong)
                said.append("; ".join(wrong))
                texts.append(canonical({"after": after, "arguments": value, "conversation": conv, "id": call, "level": level, "result": content, "status": status, "tool": tool}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "call_id", "place", "level", "status")), pa.array(valid, pa.bool_()), pa.array(said, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "call_id", "place", "level", "status", "valid", "problems", "json"])

    return run


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] = REPLY, further: bool = False) -> DataFrame:
    """``(conv_id, call_id, place, level, status, valid, problems, json)`` of each call and each orphan result; with ``further`` also of each further result of a call."""
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("place", "content")).alias("r"))
    r = first.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2"), "r.content", F.col("r.place").alias("answered")).hint("shuffle_hash")
    same = lambda a: (a.conv_id.eqNullSafe(F.col("c2"))) & (a.call_id == F.col("i2"))
    there = levels(calls).select(F.col("conv_id").alias("c3"), F.col("call_id").alias("i3"), "level")
    met = calls.join(r, same(calls), "left").join(there, calls.conv_id.eqNullSafe(F.col("c3")) & (calls.call_id == F.col("i3")), "left")
    met = met.select(calls.conv_id, calls.call_id, "tool", "arguments", "content", "after", "place", F.col("level"), F.when(F.col("i2").isNull(), "unanswered").otherwise("linked").alias("status"))
    named = calls.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2")).distinct()
    none = F.lit(None)
    alone = lambda rows, status: rows.select("conv_id", "call_id", none.cast("string").alias("tool"), none.cast("string").alias("arguments"), F.col("content").cast("string").alias("content"), none.cast("string").alias("after"), "place", none.cast("long").alias("level"), F.lit(status).alias("status"))
    out = met.unionByName(alone(results.join(named, same(results), "left_anti"), "orphan"))
    if further:
        turn = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("place", "content"))
        later = results.withColumn("turn", turn).where("turn > 1")
        out = out.unionByName(alone(later.join(named, same(later), "left_semi"), "duplicate"))
    return out.mapInArrow(_finish(schemas), "conv_id long, call_id string, place long, level long, status string, valid boolean, problems string, json string")
