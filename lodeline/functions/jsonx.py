"""Strict JSON lines as Arrow functions: raw number text, insertion order, last duplicate wins.

Spark's own JSON functions accept text after a document and single quotes and rewrite numbers, so lines that must be
told apart exactly go through here; ``native_field`` is the fast path for the rest.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
PARSED = T.StructType().add("ok", T.BooleanType()).add("is_object", T.BooleanType()).add("keys", _TEXTS).add("kinds", _TEXTS).add("raw", _TEXTS).add("text", _TEXTS)
SUB_ROWS = T.ArrayType(T.StructType().add("depth", T.IntegerType()).add("label", T.StringType()).add("value", T.StringType()))
PRETTY = T.StructType().add("ok", T.BooleanType()).add("text", T.StringType())


class Number(str):
    """A number as it is written."""


def _no_constant(name: str):
    raise ValueError(name)



def loads(line: str | bytes | None):
    """The value of one strict JSON document; ValueError otherwise."""
    if line is None:
        raise ValueError("null")
    if isinstance(line, (bytes, bytearray)):
        line = line.decode("utf-8")
    return json.loads(line, parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def dumps(value, indent: int | None = None, level: int = 0) -> str:
    """JSON text: compact, or indented by ``indent``; strings keep characters beyond ASCII."""
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, dict):
        parts = [json.dumps(k, ensure_ascii=False) + (": " if indent else ":") + dumps(v, indent, level + 1) for k, v in value.items()]
        edges = "{}"
    elif isinstance(value, list):
        parts = [dumps(v, indent, level + 1) for v in value]
        edges = "[]"
    else:
        return json.dumps(value, ensure_ascii=False)
    if not parts or not indent:
        return edges[0] + ",".join(parts) + edges[1]
    pad = "\n" + " " * (indent * (level + 1))
    return edges[0] + pad + ("," + pad).join(parts) + "\n" + " " * (indent * level) + edges[1]


def kind_of(value) -> str:
    if isinstance(value, Number):
        return "Num"
    if isinstance(value, str):
        return "Str"
    if isinstance(value, bool):
        return "Bool"
    return "Null" if value is None else "Nested"


def display(value) -> str:
    """A string bare, anything else as compact JSON."""
    return str.__str__(value) if isinstance(value, str) else dumps(value)


def _parsed(line) -> dict:
    try:
        value = loads(line)
    except (ValueError, RecursionError):
        return {"ok": False, "is_object": False, "keys": None, "kinds": None, "raw": None, "text": None}
    if not isinstance(value, dict):
        return {"ok": True, "is_object": False, "keys": [], "kinds": [], "raw": [], "text": []}
    vals = list(value.values())
    texts = [display(v) for v in vals]
    return {"ok": True, "is_object": True, "keys": list(value), "kinds": [kind_of(v) for v in vals], "raw": texts, "text": texts}


_PARSED_TYPE = pa.struct([("ok", pa.bool_()), ("is_object", pa.bool_()), ("keys", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("raw", pa.list_(pa.string())), ("text", pa.list_(pa.string()))])
_SUB_TYPE = pa.list_(pa.struct([("depth", pa.int32()), ("label", pa.string()), ("value", pa.string())]))


@F.arrow_udf(PARSED)
def parse_line(lines: pa.Array) -> pa.Array:
    return pa.array([_parsed(x) for x in lines.to_pylist()], _PARSED_TYPE)


def flatten(value, depth: int = 1) -> list[dict]:
    """Sub-rows of a record in document order; an item of a list is labelled by its place."""
    out = []
    items = value.items() if isinstance(value, dict) else ((f"[{i}]", v) for i, v in enumerate(value))
    for label, v in items:
        out.append({"depth": depth, "label": label, "value": display(v)})
        if isinstance(v, (dict, list)):
            out += flatten(v, depth + 1)
    return out


def _flat(line) -> list[dict]:
    try:
        value = loads(line)
    except (ValueError, RecursionError):
        return []
    return flatten(value) if isinstance(value, dict) else []


@F.arrow_udf(SUB_ROWS)
def flatten_line(lines: pa.Array) -> pa.Array:
    return pa.array([_flat(x) for x in lines.to_pylist()], _SUB_TYPE)


@F.arrow_udf(PRETTY)
def pretty_line(lines: pa.Array) -> pa.Array:
    """Two-space indented JSON, or the line itself where it isn't JSON."""
    out = []
    for x in lines.to_pylist():
        try:
            out.append({"ok": True, "text": dumps(loads(x), indent=2)})
        except (ValueError, RecursionError):
            out.append({"ok": False, "text": x})
    return pa.array(out, pa.struct([("ok", pa.bool_()), ("text", pa.string())]))


def json_path(path: list[str]) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)


def native_field(line: Column, path: list[str]) -> Column:
    """A value as text by Spark's parser: numbers are rewritten and null is as missing."""
    return F.get_json_object(line, json_path(path))


def field_of(parsed: Column, name: str, what: str = "text") -> Column:
    """Text, raw text or kind of a top-level field; null if it is missing."""
    at = F.array_position(parsed["keys"], name)
    return F.when(at > 0, F.get(parsed[what], (at - 1).cast("int")))


def is_expandable(parsed: Column) -> Column:
    return F.coalesce(F.array_contains(parsed["kinds"], "Nested"), F.lit(False))


def at_path(line, path: list[str]):
    """(kind, text) of a nested value of a line, or None; objects only, keys are case-sensitive."""
    try:
        value = loads(line)
    except (ValueError, RecursionError):
        return None
    for p in path:
        if not isinstance(value, dict) or p not in value:
            return None
        value = value[p]
    return kind_of(value), display(value)


def exact_field(line: Column, path: list[str]) -> Column:
    """struct<kind,text> at a path by the strict parser."""

    @F.arrow_udf("struct<kind:string,text:string>")
    def get(lines: pa.Array) -> pa.Array:
        found = [at_path(x, path) for x in lines.to_pylist()]
        return pa.array([None if f is None else {"kind": f[0], "text": f[1]} for f in found], pa.struct([("kind", pa.string()), ("text", pa.string())]))

    return get(line)


def _within(value, path: list[str]) -> str | None:
    for p in path:
        if not isinstance(value, dict) or p not in value:
            return None
        value = value[p]
    return display(value)


def exact_texts(line: Column, paths: list[list[str]]) -> Column:
    """array<string> of the values at several paths, each line parsed once by the strict parser; null where a path is missing."""

    @F.arrow_udf("array<string>")
    def get(lines: pa.Array) -> pa.Array:
        out = []
        for x in lines.to_pylist():
            try:
                value = loads(x)
            except (ValueError, RecursionError):
                out.append(None)
            else:
                out.append([_within(value, p) for p in paths])
        return pa.array(out, pa.list_(pa.string()))

    return get(line)
