"""Prompts at run time: references become values, values become text."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from ..plans.nodes import ForEachPrompt, PromptSpec, QueryValidationError, RecordPath, ResolvedPrompt


def look_up(row: Any, path: Sequence[str]) -> Any:
    """The value of a nested field; a missing key is an error, a null is a value."""
    for depth, key in enumerate(path):
        if not isinstance(row, Mapping) or key not in row:
            raise QueryValidationError(f"the row has no field {'.'.join(path[: depth + 1])}")
        row = row[key]
    return row


def _resolve(parts: Sequence[Any], row: Any, rows: Sequence[Any] | None) -> list[Any]:
    out: list[Any] = []
    for part in parts:
        if isinstance(part, ForEachPrompt):
            for each in rows or ():
                out += _resolve(part.parts, each, None)
        elif isinstance(part, RecordPath):
            if rows is not None:
                raise QueryValidationError("a Reduce prompt reaches rows through ForEach([...]) only")
            out.append(look_up(row, part.path))
        else:
            out.append(part)
    return out


def resolve_prompt(spec: PromptSpec, payload: Any, *, grouped: bool) -> ResolvedPrompt:
    """payload: a row, or the rows of a group."""
    return ResolvedPrompt(tuple(_resolve(spec.parts, payload, payload if grouped else None)), spec.output_schema)


def value_text(value: Any) -> str:
    """How a value stands in a prompt's text."""
    if isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray)):
        raise QueryValidationError("bytes cannot stand in a prompt's text")
    if value is None or isinstance(value, (bool, int, float, list, tuple, Mapping)):
        return json.dumps(dict(value) if isinstance(value, Mapping) else value, sort_keys=True)
    return str(value)
