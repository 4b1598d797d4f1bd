"""Plans over streams.

Map, Filter, Unnest and Detect are row by row and run on a stream as they are.
Reduce needs an end for its groups: a watermark and a window on an event-time
column, and a reducer with a column form.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.native import lowering_of
from ..operators.compiler import Compiler, quoted
from ..plans.nodes import ALL_ROWS, DatasetExpr, QueryValidationError, UdfSpec


def compile_stream(plan: DatasetExpr, stream: DataFrame, *, event_time: str | None = None, watermark: str = "10 minutes", window: str = "5 minutes", **options: Any) -> DataFrame:
    """The plan on a streaming DataFrame in place of its input; a Reduce adds ``window`` to its keys."""
    spark: SparkSession = stream.sparkSession
    compiler = Compiler(spark, ordered=False, **options)
    df = stream
    for node in plan.chain()[1:]:
        if node.kind != "reduce":
            df = getattr(compiler, f"_{node.kind}")(node, df)
            continue
        lower = lowering_of(node.spec) if isinstance(node.spec, UdfSpec) else None
        if lower is None or event_time is None:
            raise QueryValidationError("a Reduce on a stream needs event_time and a reducer with a column form")
        keys = [] if node.group_by == (ALL_ROWS,) else [F.col(quoted(k)) for k in node.group_by]
        new = lower({c: F.col(quoted(c)) for c in df.columns})
        df = df.withWatermark(event_time, watermark).groupBy(F.window(event_time, window), *keys).agg(*[c.alias(n) for n, c in new.items()])
    return df
