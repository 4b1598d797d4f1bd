"""Plans become lazy DataFrames.

========  ==========================================================================
node      lowering
========  ==========================================================================
Input     scan; JSON through VARIANT to typed columns
Map       registered column form; else an Arrow UDF (deterministic, so Catalyst pushes
          filters below it and prunes it); prompts: ``mapInArrow``, never reordered
Filter    as Map; a function's result counts by Python truth
Reduce    registered aggregates (partial and final); else ``applyInArrow`` per group,
          rows in input order; ``"_all"``: one aggregate row, also for empty input
Unnest    ``posexplode`` / ``posexplode_outer`` by column type
Detect    ``mapInArrow``, one detector per worker
========  ==========================================================================

A function says what it returns by its attribute ``returns`` (a DDL string or a
StructType).  Without it the results are kept as VARIANT and written once to the
shared folder (``weftline.sources.shared.release`` deletes such tables), where a
pass finds their fields: the function is not called again, also not after an
executor is lost.  A field that some rows' results lack
keeps its old value there.  Such results hold what JSON can say; dates, decimals
and bytes are an error that asks for ``returns``.

Rows go to Python as Arrow batches and ``to_pylist``, which keeps nulls,
integers and nesting; VARIANT columns travel as JSON text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from importlib.util import find_spec
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.native import lowering_of
from ..functions.prompts import resolve_prompt
from ..plans.nodes import ALL_ROWS, UDF_PACKAGE, DatasetExpr, DetectSpec, PromptSpec, QueryProgram, QueryValidationError, UdfSpec
from ..plans.schema import to_struct_type
from ..sources.scan import ORDINAL, next_place, scan, spread_variant, variant_schema
from ..sources.shared import materialise
from .detect import DETECTIONS, Backend, detect_row
from .executors import PromptExecutor

_RESULT, _GROUP = "__result", "__group"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_variant(kind.elementType)
    return isinstance(kind, T.VariantType)


class _Rows:
    """The columns of a DataFrame on their way to Python and back."""

    def __init__(self, df: DataFrame, only: Any = None) -> None:
        self.fields = [f for f in df.schema.fields if f.name != ORDINAL and (only is None or f.name in only)]
        self.coded = [f.name for f in self.fields if has_variant(f.dataType)]

    def columns(self) -> list[Column]:
        return [F.to_json(quoted(f.name)).alias(f.name) if f.name in self.coded else F.col(quoted(f.name)) for f in self.fields]

    def types(self) -> list[T.StructField]:
        return [T.StructField(f.name, T.StringType() if f.name in self.coded else f.dataType) for f in self.fields]

    def restored(self, name: str) -> Column:
        kind = next(f.dataType for f in self.fields if f.name == name)
        column = F.col(quoted(name))
        if name not in self.coded:
            return column
        parsed = F.parse_json(column)
        return (parsed if isinstance(kind, T.VariantType) else F.variant_get(parsed, "$", kind.simpleString())).alias(name)

    def reader(self) -> Callable[[Any], list[dict[str, Any]]]:
        coded = tuple(self.coded)

        def read(batch: Any) -> list[dict[str, Any]]:
            rows = batch.to_pylist()
            for row in rows if coded else ():
                for name in coded:
                    row[name] = None if row[name] is None else json.loads(row[name])
            return rows

        return read


def _plain(value: Any) -> Any:
    raise TypeError(f"{type(value).__name__} has no form in JSON; let the function declare what it returns")


def _fields(result: Any, what: str) -> dict[str, Any]:
    if not isinstance(result, Mapping):
        raise TypeError(f"{what} returned {type(result).__name__}, not a mapping")
    return dict(result)


def _place(value: Any) -> Any:
    return tuple(map(_place, value.values())) if isinstance(value, dict) else value


def _in_order(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Rows sorted by and rid of their ordinal."""
    if rows and ORDINAL in rows[0]:
        rows = sorted(rows, key=lambda r: _place(r[ORDINAL]))
    return [{k: v for k, v in r.items() if k != ORDINAL} for r in rows]


def _declared(spec: UdfSpec) -> T.StructType | None:
    returns = getattr(spec.load(), "returns", None)
    found = T.DataType.fromDDL(returns) if isinstance(returns, str) else returns
    return found if isinstance(found, T.StructType) else None


def _reads(spec: UdfSpec) -> Any:
    """The fields that a function looks at, if it says so; the scan then reads no others for it."""
    return getattr(spec.load(), "reads", None)


class Compiler:
    """Settings of a compilation.

    executor answers prompts; backend detects; base is where relative paths
    start; with ``ordered`` each row carries its place in the input, which
    ForEach and functions over groups see; ``native`` allows column forms;
    ``strict`` rejects prompt answers with other fields than the schema's;
    ``max_in_flight`` prompts are open at once in each task.
    """

    def __init__(self, spark: SparkSession, executor: PromptExecutor | None = None, *, backend: Backend | None = None, base: Path | None = None, ordered: bool = True, native: bool = True, strict: bool = False, max_in_flight: int = 8) -> None:
        self.spark, self.executor, self.backend, self.base = spark, executor, backend or Backend(), base
        self.ordered, self.native, self.strict, self.max_in_flight = ordered, native, strict, max_in_flight
        self._make_importable()

    def _make_importable(self) -> None:
        """Let Python workers find this package and ``udfs`` where the driver has them."""
        env = self.spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        for name in (__name__.split(".")[0], UDF_PACKAGE):
            spec = find_spec(name)
            for place in spec.submodule_search_locations or () if spec else ():
                if (root := str(Path(place).resolve().parent)) not in paths:
                    paths.append(root)
        env["PYTHONPATH"] = os.pathsep.join(paths)

    def compile(self, plan: DatasetExpr, source: DataFrame | None = None) -> DataFrame:
        """The DataFrame of a plan; ``source`` stands in for the input's scan."""
        df: DataFrame | None = None
        for node in plan.chain():
            df = self._input(node, source) if df is None else getattr(self, f"_{node.kind}")(node, df)
        assert df is not None
        return df

    def _input(self, node: DatasetExpr, source: DataFrame | None) -> DataFrame:
        if source is None:
            return scan(self.spark, node.input_path or "", self.base, ordinal=self.ordered)
        return source if self.ordered else source.drop(ORDINAL)

    # -- Map ---------------------------------------------------------------

    def _map(self, node: DatasetExpr, df: DataFrame) -> DataFrame:
        spec = node.spec
        if isinstance(spec, PromptSpec):
            answered = self._ask(node, df, grouped=False)
            return self._merge(answered, F.from_json(_RESULT, to_struct_type(spec.output_schema or {})), to_struct_type(spec.output_schema or {}))
        assert isinstance(spec, UdfSpec)
        if self.native and (lower := lowering_of(spec)):
            return df.withColumns(lower({c: F.col(quoted(c)) for c in df.columns}))
        rows = _Rows(df, _reads(spec))
        read, declared = rows.reader(), _declared(spec)
        name = f"{spec.module}.{spec.name}"

        def each(batch: pa.Array) -> Iterator[dict[str, Any]]:
            function = spec.load()
            return (_fields(function(row), name) for row in read(batch))

        payload = F.struct(*rows.columns())
        if declared is not None and not has_variant(declared):
            from pyspark.sql.pandas.types import to_arrow_type

            kind = to_arrow_type(declared)
            names = declared.fieldNames()
            udf = F.arrow_udf(lambda batch: pa.array([{k: r.get(k) for k in names} for r in each(batch)], kind), declared)
            return self._merge(df.withColumn(_RESULT, udf(payload)), F.col(_RESULT), declared)
        udf = F.arrow_udf(lambda batch: pa.array([json.dumps(r, default=_plain) for r in each(batch)], pa.string()), "string")
        return self._merge_open(df.withColumn(_RESULT, F.parse_json(udf(payload))))

    def _merge(self, df: DataFrame, result: Column, schema: T.StructType) -> DataFrame:
        """Fields of a typed result over the row: old ones in place, new ones at the end."""
        held = df.withColumn(_RESULT, result)
        new = {f.name: F.col(f"{_RESULT}.{quoted(f.name)}").alias(f.name) for f in schema.fields}
        return self._select(held, new)

    def _select(self, df: DataFrame, new: dict[str, Column]) -> DataFrame:
        old = [c for c in df.columns if c not in (_RESULT, ORDINAL)]
        columns = [new.get(c, F.col(quoted(c))) for c in old] + [c for name, c in new.items() if name not in old]
        return df.select(*columns, *([ORDINAL] if ORDINAL in df.columns else []))

    def _merge_open(self, df: DataFrame) -> DataFrame:
        """Fields of a VARIANT result, found by a pass over it, over the row."""
        held = materialise(df, "results")
        schema = variant_schema(held, _RESULT)
        new = {}
        for f, column in zip(schema.fields, spread_variant(_RESULT, schema), strict=True):
            if f.name in df.columns:
                raw = F.variant_get(_RESULT, "$['" + f.name.replace("'", "\\'") + "']", "variant")
                old = F.col(quoted(f.name))
                same = df.schema[f.name].dataType == f.dataType
                column = (F.when(raw.isNull(), old).otherwise(column) if same else F.when(raw.isNull(), old.cast("variant")).otherwise(raw)).alias(f.name)
            new[f.name] = column
        return self._select(held, new)

    # -- Filter ------------------------------------------------------------

    def _filter(self, node: DatasetExpr, df: DataFrame) -> DataFrame:
        spec = node.spec
        if isinstance(spec, PromptSpec):
            answered = self._ask(node, df, grouped=False)
            return answered.where(F.col(_RESULT) == "true").drop(_RESULT)
        assert isinstance(spec, UdfSpec)
        if self.native and (lower := lowering_of(spec)):
            return df.where(lower({c: F.col(quoted(c)) for c in df.columns}))
        rows = _Rows(df, _reads(spec))
        read = rows.reader()

        def keep(batch: pa.Array) -> pa.Array:
            function = spec.load()
            return pa.array([bool(function(row)) for row in read(batch)], pa.bool_())

        return df.where(F.arrow_udf(keep, "boolean")(F.struct(*rows.columns())))

    # -- Reduce ------------------------------------------------------------

    def _reduce(self, node: DatasetExpr, df: DataFrame) -> DataFrame:
        keys = () if node.group_by == (ALL_ROWS,) else node.group_by
        for key in keys:
            if key not in df.columns:  # a field that no row has is null in all
                df = df.withColumn(key, F.lit(None).cast("string"))
        place = [F.min(ORDINAL).alias(ORDINAL)] if ORDINAL in df.columns else []
        coded = {k for k in keys if has_variant(df.schema[k].dataType)}
        spec = node.spec
        if self.native and isinstance(spec, UdfSpec) and (lower := lowering_of(spec)):
            new = lower({c: F.col(quoted(c)) for c in df.columns})
            grouped = self._by(df, keys).agg(*[c.alias(f"{_RESULT}_{i}") for i, c in enumerate(new.values())], *place)
            out = {name: F.col(f"{_RESULT}_{i}").alias(name) for i, name in enumerate(new)}
            return self._keys_and(grouped, keys, out, coded)
        if isinstance(spec, PromptSpec):
            schema = to_struct_type(spec.output_schema or {})
            answered = self._ask(node, df, grouped=True, keys=keys).withColumn(_RESULT, F.from_json(_RESULT, schema))
            return self._keys_and(answered, keys, {f.name: F.col(f"{_RESULT}.{quoted(f.name)}").alias(f.name) for f in schema.fields}, coded)
        assert isinstance(spec, UdfSpec)
        declared = _declared(spec)
        if declared is not None and has_variant(declared):
            declared = None
        reduced = self._call_per_group(df, keys, spec, declared)
        if declared is not None:
            return self._keys_and(reduced, keys, {f.name: F.col(f"{_RESULT}.{quoted(f.name)}").alias(f.name) for f in declared.fields})
        held = materialise(reduced.withColumn(_RESULT, F.parse_json(_RESULT)), "results")
        schema = variant_schema(held, _RESULT)
        return self._keys_and(held, keys, dict(zip(schema.fieldNames(), spread_variant(_RESULT, schema), strict=True)))

    def _by(self, df: DataFrame, keys: tuple[str, ...]) -> Any:
        """Groups; a VARIANT key groups by its JSON text, null and JSON null alike."""
        coded = {k: F.nullif(F.to_json(quoted(k)), F.lit("null")) for k in keys if has_variant(df.schema[k].dataType)}
        return df.groupBy(*[coded.get(k, F.col(quoted(k))).alias(k) for k in keys])

    def _keys_and(self, df: DataFrame, keys: tuple[str, ...], new: dict[str, Column], coded: Any = ()) -> DataFrame:
        """Keys, then the other fields; keys in ``coded`` are JSON text still."""
        held = {k: F.parse_json(quoted(k)).alias(k) if k in coded else F.col(quoted(k)) for k in keys}
        columns = [new.get(k, held[k]) for k in keys] + [c for n, c in new.items() if n not in keys]
        return df.select(*columns, *([ORDINAL] if ORDINAL in df.columns else []))

    def _collected(self, df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, _Rows]:
        """Keys and the rows of each group in order, as an array; one row for no keys, also without input."""
        rows = _Rows(df)
        place = [F.col(ORDINAL)] if ORDINAL in df.columns else []
        held = F.collect_list(F.struct(*place, *rows.columns()))
        least = [F.min(ORDINAL).alias(ORDINAL)] if place else []
        return self._by(df, keys).agg((F.array_sort(held) if place else held).alias(_GROUP), *least), rows

    def _call_per_group(self, df: DataFrame, keys: tuple[str, ...], spec: UdfSpec, declared: T.StructType | None) -> DataFrame:
        """Keys, the function's result (as declared, else as JSON text), and the place of the group's first row."""
        from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

        name = f"{spec.module}.{spec.name}"
        returned: T.DataType = declared or T.StringType()

        def result(rows: list[dict[str, Any]], function: Callable[..., Any]) -> Any:
            found = _fields(function(rows), name)
            return {k: found.get(k) for k in declared.fieldNames()} if declared is not None else json.dumps(found, default=_plain)

        if not keys:
            grouped, rows = self._collected(df, ())
            read = rows.reader()

            returned_arrow = to_arrow_type(returned)

            def whole(batch: pa.Array) -> pa.Array:
                function = spec.load()
                return pa.array([result(_in_order(read(group.values) if group.is_valid else []), function) for group in batch], returned_arrow)

            return grouped.withColumn(_RESULT, F.arrow_udf(whole, returned)(F.col(_GROUP))).drop(_GROUP)
        only = _reads(spec)
        rows = _Rows(df, None if only is None else {*only, *keys})
        read = rows.reader()
        ordered = ORDINAL in df.columns
        sent = df.select(*rows.columns(), *([ORDINAL] if ordered else []))
        key_types = [f for f in rows.types() if f.name in keys]
        schema = T.StructType([*key_types, T.StructField(_RESULT, returned), *([df.schema[ORDINAL]] if ordered else [])])
        kind = to_arrow_schema(schema)

        def per_group(table: pa.Table) -> pa.Table:
            function = spec.load()
            raw = table.to_pylist()
            first = min(raw, key=lambda r: _place(r[ORDINAL])) if ordered else raw[0]
            out = {f.name: first[f.name] for f in key_types}
            out[_RESULT] = result(_in_order(read(table.drop_columns(list(coded.values())))), function)
            if ordered:
                out[ORDINAL] = first[ORDINAL]
            return pa.Table.from_pylist([out], schema=kind)

        # JSON null and null are one group, so VARIANT keys group by a column of their own.
        coded = {k: f"{_GROUP}_{i}" for i, k in enumerate(keys) if k in rows.coded}
        sent = sent.withColumns({c: F.nullif(F.col(quoted(k)), F.lit("null")) for k, c in coded.items()}) if coded else sent
        reduced = sent.groupBy(*[coded.get(k, quoted(k)) for k in keys]).applyInArrow(per_group, schema)
        return reduced.select(*[rows.restored(k) for k in keys], _RESULT, *([ORDINAL] if ordered else []))

    # -- Prompts -----------------------------------------------------------

    def _ask(self, node: DatasetExpr, df: DataFrame, *, grouped: bool, keys: tuple[str, ...] = ()) -> DataFrame:
        """The rows (or groups) and the answer to each one's prompt as JSON text."""
        executor, spec, kind = self.executor, node.spec, node.kind
        if executor is None:
            raise QueryValidationError(f"a {kind} prompt needs a prompt executor")
        assert isinstance(spec, PromptSpec)
        context = {"operator_name": node.name, "group_by": node.group_by, "field": node.field}
        strict, width = self.strict, max(1, self.max_in_flight)
        if grouped:
            df, inner = self._collected(df, keys)
            read_group = inner.reader()
        rows = _Rows(df)
        ordered = ORDINAL in df.columns
        read = rows.reader()

        def ask(payload: Any) -> str:
            answer = executor.execute(kind, spec, resolve_prompt(spec, payload, grouped=grouped), payload, context)
            if kind == "filter":
                return "true" if answer else "false"
            fields = _fields(answer, f"a {kind} prompt's executor")
            if strict and set(fields) != set(spec.output_schema or {}):
                raise QueryValidationError(f"a {kind} answer has the fields {sorted(fields)}, the schema {sorted(spec.output_schema or {})}")
            return json.dumps(fields, default=_plain)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(width) as pool:
                for batch in batches:
                    if grouped:
                        at = batch.schema.get_field_index(_GROUP)
                        payloads = [_in_order(read_group(g.values) if g.is_valid else []) for g in batch.column(at)]
                    else:
                        payloads = [{k: v for k, v in r.items() if k != ORDINAL} for r in read(batch)]
                    step = max(1, min(64, len(payloads) // width))  # each thread takes a few prompts at a time
                    shares = [payloads[i : i + step] for i in range(0, len(payloads), step)]
                    answers = [a for share in pool.map(lambda some: [ask(x) for x in some], shares) for a in share]
                    yield batch.append_column(_RESULT, pa.array(answers, pa.string()))

        place = [df.schema[ORDINAL]] if ordered else []
        schema = T.StructType([*rows.types(), *place, T.StructField(_RESULT, T.StringType())])
        sent = df.select(*rows.columns(), *([ORDINAL] if ordered else []))
        answered = sent.mapInArrow(run, schema)
        return answered.select(*[rows.restored(f.name) for f in rows.fields if f.name != _GROUP], *([ORDINAL] if ordered else []), _RESULT)

    # -- Unnest and Detect -------------------------------------------------

    def _unnest(self, node: DatasetExpr, df: DataFrame) -> DataFrame:
        name, keep = node.field or "", node.keep_empty
        if name not in df.columns:
            return self._select(df, {name: F.lit(None).cast("string").alias(name)}) if keep else df.where(F.lit(False))
        column, kind = F.col(quoted(name)), df.schema[name].dataType
        if isinstance(kind, T.VariantType):
            absent = column.isNull() | F.is_variant_null(column)
            items = F.when(absent, F.lit(None)).when(F.schema_of_variant(column).startswith("ARRAY"), F.try_variant_get(column, "$", "array<variant>")).otherwise(F.array(column))
        elif isinstance(kind, T.ArrayType):
            items = column
        else:
            return df if keep else df.where(column.isNotNull())
        others = [F.col(quoted(c)) for c in df.columns]
        if ORDINAL not in df.columns:
            item = (F.explode_outer if keep else F.explode)(items).alias("__item")
            return df.select(*others, item).select(*[F.col("__item").alias(c) if c == name else F.col(quoted(c)) for c in df.columns])
        out = df.select(*others, (F.posexplode_outer if keep else F.posexplode)(items).alias("__at", "__item"))
        return out.select(*[F.col("__item").alias(c) if c == name else next_place("__at") if c == ORDINAL else F.col(quoted(c)) for c in df.columns])

    def _detect(self, node: DatasetExpr, df: DataFrame) -> DataFrame:
        spec, backend = node.spec, self.backend
        assert isinstance(spec, DetectSpec)
        if spec.video_field not in df.columns:
            raise QueryValidationError(f"there is no field {spec.video_field!r} to detect in")
        rows = _Rows(df)
        read = rows.reader()
        ordered = [df.schema[ORDINAL]] if ORDINAL in df.columns else []
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(DETECTIONS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            detector = None
            for batch in batches:
                detector = detector or backend.detector(spec.model, spec.classes)
                yield batch.append_column(_RESULT, pa.array([detect_row(r, spec, backend, detector) for r in read(batch)], kind))

        schema = T.StructType([*rows.types(), *ordered, T.StructField(_RESULT, DETECTIONS)])
        found = df.select(*rows.columns(), *[f.name for f in ordered]).mapInArrow(run, schema)
        restored = found.select(*[rows.restored(f.name) for f in rows.fields], *[f.name for f in ordered], _RESULT)
        return self._select(restored, {spec.output_field: F.col(_RESULT).alias(spec.output_field)})


def _plan_of(query: DatasetExpr | QueryProgram, base: Path | None) -> tuple[DatasetExpr, Path | None]:
    if isinstance(query, QueryProgram):
        return query.output_expr, base or (Path(query.path).parent if query.path else None)
    return query, base


def compile_query(query: DatasetExpr | QueryProgram, spark: SparkSession, prompt_executor: PromptExecutor | None = None, *, base: Path | None = None, keep_ordinal: bool = False, **options: Any) -> DataFrame:
    """The lazy DataFrame of a plan or program; options: see ``Compiler``."""
    plan, base = _plan_of(query, base)
    df = Compiler(spark, prompt_executor, base=base, **options).compile(plan)
    return df if keep_ordinal else df.drop(ORDINAL)


def execute(query: DatasetExpr | QueryProgram, prompt_executor: PromptExecutor | None = None, *, spark: SparkSession | None = None, preserve_order: bool = True, **options: Any) -> list[dict[str, Any]]:
    """The result as a list of dicts, in the order of the input."""
    session = spark or SparkSession.builder.getOrCreate()
    df = compile_query(query, session, prompt_executor, keep_ordinal=True, **options)
    if preserve_order and ORDINAL in df.columns:
        df = df.orderBy(ORDINAL)
    rows = _Rows(df)
    read = rows.reader()
    return read(df.select(*rows.columns()).toArrow())
