"""Validation of JSON lines by contracts in a subset of JSON Schema."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The keywords that a contract may use.
KEYWORDS = {"$schema", "$id", "title", "description", "type", "required", "properties", "additionalProperties", "items", "enum", "const", "minLength", "maxLength", "pattern", "format", "allOf", "if", "then", "else"}
TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63,
}
FORMATS = {"date": datetime.date.fromisoformat, "date-time": datetime.datetime.fromisoformat}


def check_contract(schema: dict) -> None:
    """Refuse keywords outside the subset, wherever they stand."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"keywords outside the subset: {sorted(unknown)}")
    nested = [*schema.get("properties", {}).values(), *schema.get("allOf", []), *(schema[k] for k in ("items", "if", "then", "else") if k in schema)]
    for s in nested:
        check_contract(s)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _same(a: object, b: object) -> bool:
    """JSON equality: 1 is not true."""
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def problems(value: object, schema: dict, at: str = "$") -> Iterator[str]:
    """'path: keyword' of each keyword that does not hold."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        yield f"{at}: type"
        return
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        yield f"{at}: enum"
    if "const" in schema and not _same(value, schema["const"]):
        yield f"{at}: const"
    if isinstance(value, str):
        yield from _string_problems(value, schema, at)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{at}.{k}: required" for k in schema.get("required", []) if k not in value)
        for k, v in value.items():
            if k in known:
                yield from problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{at}.{k}: additionalProperties"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            yield from problems(v, schema["items"], f"{at}[{i}]")
    for s in schema.get("allOf", []):
        yield from problems(value, s, at)
    if "if" in schema:
        branch = "else" if any(problems(value, schema["if"], at)) else "then"
        if branch in schema:
            yield from problems(value, schema[branch], at)


def _string_problems(value: str, schema: dict, at: str) -> Iterator[str]:
    if len(value) < schema.get("minLength", 0):
        yield f"{at}: minLength"
    if len(value) > schema.get("maxLength", len(value)):
        yield f"{at}: maxLength"
    if "pattern" in schema and not re.search(schema["pattern"], value):
        yield f"{at}: pattern"
    if schema.get("format") in FORMATS:
        try:
            FORMATS[schema["format"]](value)
        except ValueError:
            yield f"{at}: format"


def validated(lines: DataFrame, schema: dict, column: str = "line") -> DataFrame:
    """lines plus `violations`, an array of strings: empty for a valid line, ['$: json'] for text that is no JSON, null for null."""
    check_contract(schema)

    def judge(text: str | None) -> list[str] | None:
        if text is None:
            return None
        try:
            value = json.loads(text, parse_constant=_no_constant)
        except ValueError:
            return ["$: json"]
        return list(problems(value, schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([judge(t) for t in b.column(column).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "violations"])

    return lines.drop("violations").mapInArrow(rows, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in lines.drop("violations").schema] + ["violations array<string>"]))
