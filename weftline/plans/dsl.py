"""Query constructors: ``Input``, ``Map``, ``Filter``, ``Reduce``, ``Unnest``, ``Detect``, ``ForEach``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from .nodes import (
    DEFAULT_DETECTOR,
    DatasetExpr,
    DetectSpec,
    ForEachPrompt,
    PromptSpec,
    QueryValidationError,
    RecordPath,
    UdfSpec,
    normalize_group_by,
    udf_spec_from_callable,
)
from .schema import normalize_output_schema

#: JSON as in the query language, and Parquet besides.
SUFFIXES = (".json", ".jsonl", ".parquet")


def _text(value: Any, what: str) -> str:
    if isinstance(value, str) and value:
        return value
    raise TypeError(f"{what} is a non-empty string")


def _dataset(value: Any) -> DatasetExpr:
    if isinstance(value, DatasetExpr):
        return value
    raise TypeError(f"an operator's source is another operator, not {type(value).__name__}")


def check_input_path(path: str) -> str:
    if path.endswith(SUFFIXES):
        return path
    raise TypeError(f"an input path ends with one of {', '.join(SUFFIXES)}")


def prompt_parts(parts: Sequence[Any], kind: str, inside: bool = False) -> tuple[Any, ...]:
    """Checked parts of a prompt.  Rows are in scope in Map and Filter, and inside of ForEach in Reduce."""
    for part in parts:
        if isinstance(part, RecordPath):
            if not part.path:
                raise QueryValidationError("Record needs a field: Record['field']")
            if kind == "reduce" and not inside:
                raise QueryValidationError("a Reduce prompt reaches rows through ForEach([...]) only; Record stands inside of it")
        elif isinstance(part, ForEachPrompt):
            if kind != "reduce" or inside:
                raise QueryValidationError("ForEach(...) stands at the top level of a Reduce prompt only")
        elif not isinstance(part, str):
            raise TypeError(f"{part!r} is no prompt part")
    return tuple(parts)


def prompt_spec(value: Any, kind: str, schema: Any) -> PromptSpec:
    if isinstance(value, str):
        parts: tuple[Any, ...] = (value,)
    elif isinstance(value, Sequence) and not isinstance(value, (bytes, bytearray)):
        parts = prompt_parts(value, kind)
    else:
        raise TypeError("a spec is a prompt, a list of prompt parts or a function of the udfs package")
    if not parts:
        raise TypeError("a prompt has at least one part")
    if kind != "filter" and schema is None:
        raise TypeError(f"a {kind} prompt needs schema=")
    return PromptSpec(parts, normalize_output_schema(schema))


def _spec(value: Any, kind: str, schema: Any = None) -> PromptSpec | UdfSpec:
    if not callable(value):
        return prompt_spec(value, kind, schema)
    if schema is not None:
        raise TypeError("schema= belongs to prompts; a function declares its result by its ``returns`` attribute")
    return udf_spec_from_callable(value)


def Input(path: str) -> DatasetExpr:
    """Rows of a JSON list, JSON lines or Parquet file."""
    return DatasetExpr("input", input_path=check_input_path(_text(path, "an input path")))


def Map(data: DatasetExpr, spec: str | Sequence[Any] | Callable[..., Any], *, schema: Any = None, name: str | None = None) -> DatasetExpr:
    """Merge what the spec returns into each row."""
    return DatasetExpr("map", _dataset(data), spec=_spec(spec, "map", schema), name=name)


def Filter(data: DatasetExpr, spec: str | Sequence[Any] | Callable[..., Any], *, name: str | None = None) -> DatasetExpr:
    """Keep the rows for which the spec is true, in Python's sense."""
    return DatasetExpr("filter", _dataset(data), spec=_spec(spec, "filter"), name=name)


def Reduce(data: DatasetExpr, group_by: str | Sequence[str], reducer: str | Sequence[Any] | Callable[..., Any], *, schema: Any = None, name: str | None = None) -> DatasetExpr:
    """One row per group: its keys and what the reducer returns.  ``"_all"`` is one group of all rows."""
    return DatasetExpr("reduce", _dataset(data), spec=_spec(reducer, "reduce", schema), group_by=normalize_group_by(group_by), name=name)


def Unnest(data: DatasetExpr, field: str, *, keep_empty: bool = False, name: str | None = None) -> DatasetExpr:
    """One row per item of a list field; other values pass, null and empty ones go unless ``keep_empty``."""
    return DatasetExpr("unnest", _dataset(data), field=_text(field, "an Unnest field"), keep_empty=bool(keep_empty), name=name)


def Detect(data: DatasetExpr, video_field: str, classes: Sequence[str], *, model: str = DEFAULT_DETECTOR, output_field: str = "detections", name: str | None = None) -> DatasetExpr:
    """Detect objects of the classes in each frame of a video; one entry per class found."""
    if not isinstance(classes, (list, tuple)) or not classes:
        raise TypeError("Detect classes is a non-empty list of strings")
    named = tuple(_text(c, "each of the Detect classes") for c in classes)
    spec = DetectSpec(_text(video_field, "the Detect video_field"), named, _text(model, "the Detect model"), _text(output_field, "the Detect output_field"))
    return DatasetExpr("detect", _dataset(data), spec=spec, name=name)


def ForEach(parts: Sequence[Any]) -> ForEachPrompt:
    return ForEachPrompt(prompt_parts(parts, "reduce", inside=True))
