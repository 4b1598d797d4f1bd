"""Scans: Parquet as it is, JSON lines and JSON lists through VARIANT.

Every scan adds ``ORDINAL``, the place of the row in its input, which stays
with the row through the operators; nothing is sorted unless the caller asks.

JSON fields that have one type everywhere become typed columns; fields of mixed
types stay VARIANT, so nothing turns into text silently.
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import QueryValidationError

ORDINAL = "__ordinal"
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def resolve_path(path: str, base: Path | None) -> str:
    """Relative paths start at the query's folder; paths with a scheme are Spark's."""
    return path if _SCHEME.match(path) or Path(path).is_absolute() or base is None else str(base / path)


def _checked(spark: SparkSession, path: str) -> str:
    """The path, if Spark finds it; one without a scheme is looked up in Spark's default file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise QueryValidationError(f"there is no input {path}")
    return path


def _place() -> Column:
    # Spark may take files and splits in any order, so their names and offsets lead.
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def next_place(position: str) -> Column:
    """The place of an item of a row: the row's, then the item's position.  A struct around the old one, which is never taken apart."""
    return F.struct(F.col(ORDINAL).alias("row"), F.coalesce(F.col(position), F.lit(0)).alias("item")).alias(ORDINAL)


def _no_json() -> Column:
    """What is said of a line that is no JSON.  Lines are counted from the start of the split, which for most files is the whole file."""
    line = F.col(ORDINAL)["row"].bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return F.concat(F.lit("invalid JSON in "), F.col(ORDINAL)["file"], F.lit(" at line "), line.cast("string"), F.lit(" from byte "), F.col(ORDINAL)["block"].cast("string"), F.lit(": "), F.substring("value", 1, 200))


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """ORDINAL and ``v``, one object each."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(_place().alias(ORDINAL), F.parse_json("value").alias("v"))
        listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v").cast("array<variant>")).otherwise(F.raise_error(F.lit(f"{path} does not hold a list")).cast("array<variant>"))
        rows = whole.select(ORDINAL, F.posexplode(listed).alias("_at", "v"))
        rows = rows.select(next_place("_at"), "v")
    else:
        lines = spark.read.text(path).select("value", _place().alias(ORDINAL))
        held = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
        parsed = F.try_parse_json("value")
        rows = held.select(ORDINAL, F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(_no_json()).cast("variant")).alias("v"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    return rows.withColumn("v", F.when(is_object, F.col("v")).otherwise(F.raise_error(F.lit(f"{path} has a row that is no object")).cast("variant")))


def typed(kind: T.DataType) -> T.DataType:
    """Decimals of JSON are floats; a field that is always null is a string."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, typed(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(typed(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, T.NullType) else kind


def variant_schema(rows: DataFrame, column: str = "v") -> T.StructType:
    """The type of all objects of a VARIANT column; one pass, one row to the driver."""
    ddl = rows.agg(F.schema_of_variant_agg(column)).first()[0]
    if not ddl.startswith("OBJECT<"):
        return T.StructType([])
    # Between backquotes stand field names, which stay as they are.
    spelled = "`".join(part if at % 2 else part.replace("OBJECT<", "STRUCT<") for at, part in enumerate(ddl.split("`")))
    found = typed(T.DataType.fromDDL(spelled))
    assert isinstance(found, T.StructType)
    return found


def spread_variant(column: str, schema: T.StructType) -> list[Column]:
    """A column for each field of the objects."""
    return [F.variant_get(column, "$['" + f.name.replace("'", "\\'") + "']", f.dataType.simpleString()).alias(f.name) for f in schema.fields]


def scan(spark: SparkSession, path: str, base: Path | None = None, schema: T.StructType | str | None = None, ordinal: bool = True) -> DataFrame:
    """Rows and, if wanted, ORDINAL.  schema: of JSON input, to save the pass that finds it."""
    full = _checked(spark, resolve_path(path, base))
    if full.endswith(".parquet"):
        held = spark.read.parquet(full)
        return held.select("*", _place().alias(ORDINAL)) if ordinal else held
    if not full.endswith((".json", ".jsonl")):
        raise QueryValidationError(f"{full} is neither .json, .jsonl nor .parquet")
    rows = _objects(spark, full)
    known: Any = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    return rows.select(*spread_variant("v", known if known is not None else variant_schema(rows)), *([ORDINAL] if ordinal else []))
