"""Helpers that the training-data operators share.

Nothing outside ``weftline.llm`` (and ``corpus_pipeline.py``) imports this
package, so that it can be removed as a whole.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, release, shared_dir, written

__all__ = ["HOT", "HOT_KEYS", "ROW_KEY", "documents", "keyed", "left_join_spread", "materialise", "partitions", "prepare", "release", "row_key", "shared_dir", "text_columns", "text_slices", "written"]

#: What the row-identity column is called inside the operators.
ROW_KEY = "_w_row"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows go to Python in batches of so many bytes; Spark's own limit is four times that, in both processes and for each task.
_BATCH = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by ``sys.path`` alone; keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: Keys with more rows are told by broadcast, if they are among the 100,000 at most that can have a 100,000th of all rows.
HOT = 200
HOT_KEYS = 100_000
#: So many narrow rows are nothing for one task: below, no key is hot.
FEW = 50_000


def left_join_spread(rows: DataFrame, told: DataFrame, keys: list[Column], n_rows: int, values: list[str]) -> DataFrame:
    """``rows`` and, for each, the ``values`` that ``told`` has for its ``keys`` (null if it has none).

    told: one row for each key, with _w_k0, _w_k1, ... (long, not null), _w_n
    (how many rows have the key) and the values.  Keys with more than ``HOT``
    rows, and more than a 100,000th of all, are broadcast (there are 100,000 of
    them at most); their rows do not meet in the exchange by key.
    ``FEW`` rows or less are joined as they are.
    """
    named = [f"_w_k{i}" for i in range(len(keys))]
    out = [f"_ws_value{i}" for i in range(len(values))]
    if n_rows <= FEW:
        held = rows.withColumns({f"_ws_key{i}": k for i, k in enumerate(keys)})
        rest = told.select(*named, *[F.col(v).alias(o) for o, v in zip(out, values, strict=True)])
        found = held.join(rest, [F.col(f"_ws_key{i}") == F.col(n) for i, n in enumerate(named)], "left")
        return found.select(*rows.columns, *[F.col(o).alias(v) for o, v in zip(out, values, strict=True)])
    is_hot = F.col("_w_n") > max(HOT, n_rows // HOT_KEYS)
    of = lambda done, parts: F.struct(F.lit(done).alias("done"), *[c.alias(f"k{i}") for i, c in enumerate(parts)])
    few = told.where(is_hot).select(of(False, map(F.col, named)).alias("_ws_hot"), *[F.col(v).alias(f"_ws_hot{i}") for i, v in enumerate(values)])
    rest = told.where(~is_hot).select(of(False, map(F.col, named)).alias("_ws_other"), *[F.col(v).alias(o) for o, v in zip(out, values, strict=True)])
    held = rows.withColumn("_ws_key", of(False, keys)).join(F.broadcast(few), F.col("_ws_key") == F.col("_ws_hot"), "left")
    # Rows that have been told go anywhere, and no key of the rest is like theirs.
    anywhere = of(True, [F.xxhash64(*map(F.col, rows.columns), F.monotonically_increasing_id()), *[F.lit(0).cast("long")] * (len(keys) - 1)])
    held = held.withColumn("_ws_key", F.when(F.col("_ws_hot").isNull(), F.col("_ws_key")).otherwise(anywhere))
    found = held.join(rest, F.col("_ws_key") == F.col("_ws_other"), "left")
    return found.select(*rows.columns, *[F.coalesce(f"_ws_hot{i}", o).alias(v) for i, (o, v) in enumerate(zip(out, values, strict=True))])


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that tell rows with the same doc_id but other texts apart; joined together with doc_id."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key; any other columns of ``docs`` are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(ROW_KEY, row_key())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Let the system have what this worker has freed: workers live on between tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def text_columns(batch, at: int, most_bytes: int = 4 << 20):
    """(start, part) of a record batch's string column, a few MB at a time."""
    import numpy as np
    import pyarrow.compute as pc

    column = batch.column(at)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start, n = 0, len(column)
    while start < n:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield start, column.slice(start, stop - start)
        start = stop
    give_back()


def text_slices(batch, at: int, most_bytes: int = 4 << 20):
    """(start, texts) of a record batch's string column, a few MB at a time."""
    for start, column in text_columns(batch, at, most_bytes):
        yield start, column.to_pylist()
