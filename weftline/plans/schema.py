"""Output schemas of prompts: short form, JSON-schema form and Spark type."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "number": T.DoubleType, "integer": T.LongType, "boolean": T.BooleanType}


def _checked_json(value: Any) -> Any:
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, list):
        return [_checked_json(x) for x in value]
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        return {k: _checked_json(v) for k, v in value.items()}
    raise TypeError(f"schema= holds JSON literals only, not {value!r}")


def _field(value: Any) -> Any:
    if isinstance(value, str) and value:
        return value
    if not isinstance(value, dict):
        raise TypeError(f"a field's schema is a type name or a JSON-schema fragment, not {value!r}")
    fragment = _checked_json(value)
    return fragment["type"] if list(fragment) == ["type"] and isinstance(fragment["type"], str) else fragment


def _unwrapped(value: dict[str, Any]) -> dict[str, Any]:
    """The fields of ``{"type": "object", "properties": ..., "required": ...}``, all of which must be required."""
    if extra := set(value) - {"type", "properties", "required"}:
        raise TypeError(f"an object schema has type, properties and required only, not {sorted(map(str, extra))}")
    fields, required = value.get("properties"), value.get("required")
    if value.get("type") != "object" or not isinstance(fields, dict) or not isinstance(required, list):
        raise TypeError("an object schema has type 'object', a dict of properties and a list of required fields")
    if sorted(map(str, required)) != sorted(map(str, fields)):
        raise TypeError("an object schema must list every property as required")
    return fields


def normalize_output_schema(value: Any) -> dict[str, Any] | None:
    """Field name -> type name or fragment; also takes the object form."""
    if value is None:
        return None
    if not isinstance(value, dict):
        raise TypeError("schema= maps field names to types")
    if {"properties", "required"} & set(value) or value.get("type") == "object":
        value = _unwrapped(value)
    if not all(isinstance(k, str) and k for k in value):
        raise TypeError("schema= field names are non-empty strings")
    return {k: _field(v) for k, v in value.items()}


def expand_output_schema(schema: dict[str, Any] | None) -> dict[str, Any] | None:
    """The object form that a provider gets, fields in order of name."""
    if schema is None:
        return None
    names = sorted(schema)
    return {"type": "object", "properties": {n: {"type": schema[n]} if isinstance(schema[n], str) else schema[n] for n in names}, "required": names}


def to_spark_type(fragment: Any) -> T.DataType:
    """The column type of a fragment; VARIANT where JSON schema leaves it open."""
    if isinstance(fragment, str):
        fragment = {"type": fragment}
    kind = fragment.get("type")
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        return to_spark_type({**fragment, "type": rest[0]}) if len(rest) == 1 else T.VariantType()
    if kind in _SIMPLE:
        return _SIMPLE[kind]()
    if kind == "array":
        return T.ArrayType(to_spark_type(fragment["items"]) if "items" in fragment else T.VariantType())
    if kind == "object" and fragment.get("properties"):
        return T.StructType([T.StructField(n, to_spark_type(f)) for n, f in fragment["properties"].items()])
    branches = [b for b in fragment.get("anyOf", ()) if b != {"type": "null"}]
    return to_spark_type(branches[0]) if len(branches) == 1 else T.VariantType()


def to_struct_type(schema: dict[str, Any]) -> T.StructType:
    return T.StructType([T.StructField(n, to_spark_type(f)) for n, f in schema.items()])
