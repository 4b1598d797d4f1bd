"""Column forms of functions, for the compiler to use instead of Python.

``native(udfs.module.function)(lowering)``: for Map the lowering gets a mapping
of column names to columns and returns columns by field name, for Filter one
column, for Reduce aggregate columns by field name.  It must mean the same as
the function on typed rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.nodes import UdfSpec

Lowering = Callable[[Mapping[str, Column]], Any]
_KNOWN: dict[UdfSpec, Lowering] = {}


def native(module: str, name: str) -> Callable[[Lowering], Lowering]:
    def add(lowering: Lowering) -> Lowering:
        _KNOWN[UdfSpec(module, name)] = lowering
        return lowering

    return add


def lowering_of(spec: UdfSpec) -> Lowering | None:
    return _KNOWN.get(spec)


@native("udfs.test_ops", "add_bucket")
def _add_bucket(row: Mapping[str, Column]) -> dict[str, Column]:
    return {"bucket": F.floor(row["value"] / 2).cast("long")}


@native("udfs.test_ops", "keep_large")
def _keep_large(row: Mapping[str, Column]) -> Column:
    return row["value"] >= 2


@native("udfs.test_ops", "summarize_group")
def _summarize_group(row: Mapping[str, Column]) -> dict[str, Column]:
    return {"total": F.coalesce(F.sum(row["value"]), F.lit(0)), "count": F.count(F.lit(1))}


@native("udfs.test_ops", "annotate")
def _annotate(row: Mapping[str, Column]) -> dict[str, Column]:
    return {"label": F.concat(F.lit("v"), row["value"].cast("string"))}
