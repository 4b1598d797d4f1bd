"""Queries over the test tables, one or more for each operator, and SQL of equal meaning.

``udf`` in a name: functions run as Python; ``native``: as columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from udfs import table_ops as ops

from .functions.native import native
from .functions.prompts import value_text
from .functions.video_math import frame_range, offset_text
from .operators.compiler import compile_query
from .operators.detect import Backend
from .operators.executors import StaticPromptExecutor
from .plans.dsl import Detect, Filter, ForEach, Input, Map, Reduce, Unnest
from .plans.nodes import DatasetExpr, PromptSpec, Record
from .plans.rewrite import optimize
from .plans.text import parse_query, render_query
from .sources.scan import ORDINAL
from .sources.shared import shared_dir
from .streaming.queries import compile_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


@native("udfs.table_ops", "tag_event")
def _tag_event(row: Any) -> dict[str, Any]:
    tags = F.when(row["event_type"] == "view", F.array().cast("array<string>")).otherwise(F.array(row["event_type"], F.lit("all")))
    return {"bucket": F.floor(row["user_id"] / 2).cast("long"), "tags": tags}


@native("udfs.table_ops", "known_user")
def _known_user(row: Any) -> Any:
    return row["user_id"] >= 2


@native("udfs.table_ops", "sum_ids")
def _sum_ids(row: Any) -> dict[str, Any]:
    return {"total": F.sum(row["event_id"]), "count": F.count(F.lit(1))}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = " ".join(sql.split())
        return query

    return add


def _events(sf_dir: str) -> DatasetExpr:
    return Input(f"{sf_dir}/events.parquet")


def _run(spark: SparkSession, plan: DatasetExpr, **options: Any) -> DataFrame:
    return compile_query(plan, spark, ordered=options.pop("ordered", False), **options)


@_query("select event_id, user_id, user_id // 2 as bucket from events")
def map_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Map(_events(sf_dir), ops.bucket_user)).select("event_id", "user_id", "bucket")


@_query("select event_id, user_id * 10 as user_id, event_type from events")
def map_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Map(_events(sf_dir), ops.scale_user)).select("event_id", "user_id", "event_type")


@_query("select event_id, value from events where value >= 100")
def filter_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Filter(_events(sf_dir), ops.is_large)).select("event_id", "value")


@_query("select user_id, round(sum(value), 4) as total, count(*) as count from events group by user_id")
def reduce_keyed_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Reduce(_events(sf_dir), "user_id", ops.sum_values))


@_query("select user_id, cast(sum(event_id) as bigint) as total, count(*) as count from events group by user_id")
def reduce_keyed_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Reduce(_events(sf_dir), "user_id", ops.sum_ids))


@_query("select cast(sum(event_id) as bigint) as total, count(*) as count from events")
def reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Reduce(_events(sf_dir), "_all", ops.sum_ids))


@_query("select cast(sum(event_id) as bigint) as total, count(*) as count from events where false")
def reduce_all_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Reduce(Filter(_events(sf_dir), ops.never), "_all", ops.sum_ids), native=False)


@_query("""select case when user_id % 3 = 0 then null else user_id end as user_id, cast(sum(event_id) as bigint) as total, count(*) as count
from events group by 1""")
def reduce_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Reduce(Map(_events(sf_dir), ops.forget_third), "user_id", ops.sum_ids))


@_query("select vec_id, unnest(embedding) as embedding from embeddings")
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Unnest(Input(f"{sf_dir}/embeddings.parquet"), "embedding")).select("vec_id", "embedding")


@_query("select event_id, unnest(case when event_type in ('error', 'view') then [] else [event_type, 'x'] end) as tags from events")
def unnest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Unnest(Map(_events(sf_dir), ops.two_tags), "tags")).select("event_id", "tags")


@_query("select event_id, unnest(case when event_type in ('error', 'view') then [null] else [event_type, 'x'] end) as tags from events")
def unnest_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, Unnest(Map(_events(sf_dir), ops.two_tags), "tags", keep_empty=True)).select("event_id", "tags")


def _parts_text(resolved: Any, payload: Any, context: Any) -> dict[str, str]:
    return {"summary": "".join(map(value_text, resolved.parts))}


def _answers(kind: str, parts: list[Any]) -> StaticPromptExecutor:
    return StaticPromptExecutor({(kind, PromptSpec(tuple(parts)).cache_key()): _parts_text})


@_query("select event_id, cast(cast(json_extract(props, '$.k') as bigint) as varchar) as summary from events")
def record_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [Record["props"]["k"]]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k bigint").alias("props"))
    plan = Map(_events(sf_dir), parts, schema={"summary": "string"})
    return _with_source(spark, plan, events, _answers("map", parts)).select("event_id", "summary")


def _with_source(spark: SparkSession, plan: DatasetExpr, source: DataFrame, executor: Any = None, **options: Any) -> DataFrame:
    from .operators.compiler import Compiler

    return Compiler(spark, executor, ordered=ORDINAL in source.columns, **options).compile(plan, source).drop(ORDINAL)


@_query("select o_orderkey, 'Order ' || cast(o_orderkey as varchar) || ' is ' || o_orderstatus as summary from orders")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["Order ", Record["o_orderkey"], " is ", Record["o_orderstatus"]]
    plan = Map(Input(f"{sf_dir}/orders.parquet"), parts, schema={"summary": "string"})
    return _run(spark, plan, prompt_executor=_answers("map", parts)).select("o_orderkey", "summary")


def _is_open(resolved: Any, payload: Any, context: Any) -> bool:
    return payload["o_orderstatus"] == "O"


@_query("select o_orderkey from orders where o_orderstatus = 'O'")
def prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["Is ", Record["o_orderstatus"], " open?"]
    executor = StaticPromptExecutor({("filter", PromptSpec(tuple(parts)).cache_key()): _is_open})
    return _run(spark, Filter(Input(f"{sf_dir}/orders.parquet"), parts), prompt_executor=executor).select("o_orderkey")


@_query("select conv_id, 'Turns:' || chr(10) || string_agg('- ' || role || chr(10), '' order by turn) as summary from conversations group by conv_id")
def foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["Turns:\n", ForEach(["- ", Record["role"], "\n"])]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "role", F.struct("turn").alias(ORDINAL))
    plan = Reduce(Input(f"{sf_dir}/conversations.parquet"), "conv_id", parts, schema={"summary": "string"})
    return _with_source(spark, plan, turns, _answers("reduce", parts))


@_query("""select event_id, cast(trunc(value * f) as bigint) as start_frame, least(cast(trunc((value + user_id % 7) * f) as bigint), 3000 + event_id) as end_frame,
greatest(0, least(cast(trunc((value + user_id % 7) * f) as bigint), 3000 + event_id) - cast(trunc(value * f) as bigint)) as num_frames
from (select *, case when event_id % 5 = 0 then 30.0::double else 29.97::double end as f from events)""")
def view_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id")
    fps = F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).otherwise(F.lit(29.97))
    found = frame_range(F.col("value"), F.col("value") + F.col("user_id") % 7, fps, F.lit(3000) + F.col("event_id"))
    return events.select("event_id", *[c.alias(n) for n, c in found.items()])


@_query("select l_orderkey, l_linenumber, cast(cast(l_quantity as bigint) as varchar) || 's' as start_offset from lineitem")
def offset_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", offset_text(F.col("l_quantity")).alias("start_offset"))


def _tag_plan(sf_dir: str) -> DatasetExpr:
    tagged = Filter(Map(_events(sf_dir), ops.tag_event), ops.known_user)
    return Reduce(Unnest(tagged, "tags", keep_empty=True), ["bucket", "tags"], ops.sum_ids)


_TAG_SQL = """select user_id // 2 as bucket, tags, cast(sum(event_id) as bigint) as total, count(*) as count
from (select event_id, user_id, unnest(case when event_type = 'view' then [null] else [event_type, 'all'] end) as tags from events where user_id >= 2) group by 1, 2"""


@_query(_TAG_SQL)
def chain_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _tag_plan(sf_dir), native=False)


@_query(_TAG_SQL)
def chain_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _tag_plan(sf_dir))


@_query(_TAG_SQL)
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, parse_query(render_query(_tag_plan(sf_dir))))


@_query(_TAG_SQL)
def optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, optimize(_tag_plan(sf_dir)))


@_query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}.jsonl"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus").write.json(path)
    return _run(spark, Input(path)).select("o_orderkey", "o_totalprice", "o_orderstatus")


@_query("select o_orderkey, case when o_orderkey % 3 = 0 then cast(o_orderkey as varchar) when o_orderkey % 3 = 1 then '\"' || o_orderstatus || '\"' else '[1,\"' || o_orderstatus || '\"]' end as v from orders")
def json_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is a number, a string or a list, as JSON text."""
    path = f"{shared_dir(spark)}/mixed-{uuid.uuid4().hex}.jsonl"
    value = F.expr("""case when o_orderkey % 3 = 0 then cast(o_orderkey as string) when o_orderkey % 3 = 1 then concat('"', o_orderstatus, '"') else concat('[1,"', o_orderstatus, '"]') end""")
    line = F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "v": '), value, F.lit("}"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(line.alias("value")).write.text(path)
    return _run(spark, Input(path)).select("o_orderkey", F.to_json("v").alias("v"))


def _count_turns(resolved: Any, payload: Any, context: Any) -> dict[str, int]:
    return {"turns": len(payload)}


@_query("select conv_id, count(*) as turns from conversations group by conv_id")
def prompt_reduce_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Reduce(Input(f"{sf_dir}/conversations.parquet"), "conv_id", "How many turns are there?", schema={"turns": "integer"})
    return _run(spark, plan, prompt_executor=StaticPromptExecutor({("reduce", "How many turns are there?"): _count_turns}))


@_query("""select conv_id, 'Turns of ' || conv_id || ':' || repeat('+', cast(count(*) as int)) as summary from conversations where role <> 'system' group by conv_id""")
def text_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt parts, Record and ForEach through the text form and back."""
    ask, label, each = ["Is ", Record["role"], " a speaker?"], ["of ", Record["conv_id"], ":"], ["Turns ", ForEach(["+"])]
    spoken = Map(Filter(Input(f"{sf_dir}/conversations.parquet"), ask), label, schema={"label": "string"})
    program = parse_query(render_query(Reduce(spoken, ["conv_id", "label"], each, schema={"summary": "string"})))
    executor = StaticPromptExecutor({
        ("filter", PromptSpec(tuple(ask)).cache_key()): _speaks,
        ("map", PromptSpec(tuple(label)).cache_key()): _label,
        ("reduce", PromptSpec(tuple(each)).cache_key()): _parts_text,
    })
    out = _run(spark, program, prompt_executor=executor)
    return out.select("conv_id", F.concat(F.substring_index("summary", " ", 1), F.lit(" "), F.col("label"), F.substring_index("summary", " ", -1)).alias("summary"))


def _speaks(resolved: Any, payload: Any, context: Any) -> bool:
    return resolved.parts[1] != "system"


def _label(resolved: Any, payload: Any, context: Any) -> dict[str, str]:
    return {"label": "".join(map(value_text, resolved.parts))}


class _OneBox(Backend):
    """Frames and boxes made from the video's name: for tests without media."""

    def open(self, source: str, start: float | None, end: float | None) -> Any:
        event, kind = source.split("/")
        return _Frames(int(event), [] if kind == "view" else [kind])

    def detector(self, model: str, classes: Any) -> Any:
        return lambda frame: [(frame, [0.0, 0.0, 1.0, 1.0], 0.5)]


class _Frames(list):
    def __init__(self, start_frame: int, kinds: list[str]) -> None:
        super().__init__(kinds)
        self.start_frame = start_frame


@_query("select event_id, event_type as type, event_id as frame_idx from events where event_type <> 'view'")
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat_ws("/", "event_id", "event_type").alias("video"))
    plan = Unnest(Detect(_events(sf_dir), "video", ["any"]), "detections")
    return _with_source(spark, plan, events, backend=_OneBox()).select("event_id", F.col("detections.type").alias("type"), F.col("detections.bboxes")[0]["frame_idx"].alias("frame_idx"))


@_query("""select event_id, tags from (select event_id, user_id, unnest(case when event_type = 'view' then [] else [event_type, 'all'] end) as tags from events) where user_id >= 2""")
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map, Filter and Unnest on a stream of the events, run to its end."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source takes folders; a single file is found by a pattern.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path + "*")
    plan = Unnest(Filter(Map(_events(sf_dir), ops.tag_event), ops.known_user), "tags")
    out = compile_stream(plan, stream).select("event_id", "tags")
    done = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@_query("""select event_type, strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M:%S') as began, cast(sum(event_id) as bigint) as total, count(*) as count
from events group by 1, 2""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed Reduce over windows of event time, the stream run to its end; the last batch leaves all windows."""
    root = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))
    plan = Reduce(_events(sf_dir), "event_type", ops.sum_ids)
    began = F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("began")
    out = compile_stream(plan, stream, event_time="ts").select("event_type", began, "total", "count")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out")
    done = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
