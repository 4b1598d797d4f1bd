"""Compiled plans on the fixtures, against expected rows and a plain Python model."""

import json
import random
import sys
from pathlib import Path

import pytest

import weftline as wl
from udfs import table_ops
from udfs.test_ops import add_bucket, annotate, keep_large, summarize_group
from weftline import Detect, Filter, ForEach, Input, Map, QueryValidationError, Record, Reduce, StaticPromptExecutor, Unnest
from weftline.operators.detect import Backend


def lines(path: Path, rows) -> str:
    path.write_text("\n" + "\n\n".join(map(json.dumps, rows)) + "\n")
    return str(path)


def listed(path: Path, rows) -> str:
    path.write_text(json.dumps(rows))
    return str(path)


PIPELINE = [{"value": 1, "tags": ["a", "b"]}, {"value": 2, "tags": ["c"]}, {"value": 4, "tags": []}]


@pytest.mark.parametrize("native", [True, False])
def test_pipeline(spark, tmp_path, native):
    plan = Reduce(Unnest(Filter(Map(Input(lines(tmp_path / "r.jsonl", PIPELINE)), add_bucket), keep_large), "tags", keep_empty=True), "bucket", summarize_group)
    assert wl.execute(plan, spark=spark, native=native) == [{"bucket": 1, "total": 2, "count": 1}, {"bucket": 2, "total": 4, "count": 1}]


def test_prompts_in_order(spark, tmp_path):
    rows = [{"title": f"Clip {c}", "video": {"type": "Video", "uri": f"u{c}"}} for c in "BAC"]
    each, all_ = ["Sum ", Record["title"], Record["video"]], ["Bullets:\n", ForEach(["- ", Record["bullet"], "\n"])]
    executor = StaticPromptExecutor({
        ("map", wl.PromptSpec(tuple(each)).cache_key()): lambda r, row, c: {"bullet": f"{row['title']}::{r.parts[2]['uri']}", "more": 1},
        ("reduce", wl.PromptSpec(tuple(all_)).cache_key()): lambda r, rows, c: {"report": "".join(r.parts)},
    })
    plan = Reduce(Map(Input(lines(tmp_path / "r.jsonl", rows)), each, schema={"bullet": "string"}), "_all", all_, schema={"report": "string"})
    assert wl.execute(plan, executor, spark=spark) == [{"report": "Bullets:\n- Clip B::uB\n- Clip A::uA\n- Clip C::uC\n"}]
    with pytest.raises(Exception, match="fields"):
        wl.execute(plan, executor, spark=spark, strict=True)
    with pytest.raises(QueryValidationError):
        wl.execute(plan, spark=spark)


def test_prompt_filter_and_keyed_reduce(spark, tmp_path):
    data = Input(lines(tmp_path / "r.jsonl", [{"k": 1, "v": "x"}, {"k": None, "v": "y"}, {"k": 1, "v": ""}, {"v": "z"}]))
    executor = StaticPromptExecutor({("filter", "has v?"): lambda r, row, c: row["v"], ("reduce", "join"): lambda r, rows, c: {"all": "".join(x["v"] for x in rows), "k2": c["group_by"][0]}})
    plan = Reduce(Filter(data, "has v?"), "k", "join", schema={"all": "string", "k2": "string"})
    assert wl.execute(plan, executor, spark=spark) == [{"k": 1, "all": "x", "k2": "k"}, {"k": None, "all": "yz", "k2": "k"}]


def test_mixed_unnest(spark, tmp_path):
    data = Input(listed(tmp_path / "r.json", [{"value": 1, "tags": "solo"}, {"value": 2, "tags": []}, {"value": 3}, {"value": 4, "tags": [None, {"a": 1}]}]))
    kept = [(r["value"], r["tags"]) for r in wl.execute(Unnest(data, "tags", keep_empty=True), spark=spark)]
    assert kept == [(1, "solo"), (2, None), (3, None), (4, None), (4, {"a": 1})]
    assert [r["value"] for r in wl.execute(Unnest(data, "tags"), spark=spark)] == [1, 4, 4]
    assert wl.execute(Unnest(data, "nowhere"), spark=spark) == []
    assert {r["nowhere"] for r in wl.execute(Unnest(data, "nowhere", keep_empty=True), spark=spark)} == {None}
    assert len(wl.execute(Unnest(data, "value"), spark=spark)) == 4


def test_relative_path_and_text(spark, tmp_path):
    lines(tmp_path / "docs.jsonl", [{"tags": ["a", "b"]}, {"tags": []}])
    query = tmp_path / "query.py"
    query.write_text('docs = Input("docs.jsonl")\noutput = Unnest(docs, "tags", keep_empty=True)\n')
    assert wl.execute(wl.load_query(query), spark=spark) == [{"tags": "a"}, {"tags": "b"}, {"tags": None}]


def test_input_errors(spark, tmp_path):
    with pytest.raises(QueryValidationError):
        wl.execute(Input(str(tmp_path / "none.json")), spark=spark)
    for name, text in (("object.json", '{"a": 1}'), ("bad.jsonl", '{"a": 1}\n{"a": '), ("scalar.jsonl", '{"a": 1}\n5'), ("scalar.json", "[1]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017  the kind is Spark's
            wl.execute(Input(str(tmp_path / name)), spark=spark)


def test_empty_input_and_groups(spark, tmp_path):
    data = Filter(Input(lines(tmp_path / "r.jsonl", [{"value": 0}])), keep_large)
    for native in (True, False):
        assert wl.execute(Reduce(data, "_all", summarize_group), spark=spark, native=native) == [{"total": 0, "count": 0}]
        assert wl.execute(Reduce(data, "value", summarize_group), spark=spark, native=native) == []


def test_null_and_variant_keys(spark, tmp_path):
    data = Input(lines(tmp_path / "r.jsonl", [{"k": "a", "value": 1}, {"k": None, "value": 2}, {"value": 3}, {"k": [1], "value": 4}, {"k": "a", "value": 5}]))
    want = [{"k": "a", "total": 6, "count": 2}, {"k": None, "total": 5, "count": 2}, {"k": [1], "total": 4, "count": 1}]
    for native in (True, False):
        assert wl.execute(Reduce(data, "k", summarize_group), spark=spark, native=native) == want
    assert wl.execute(Reduce(data, ["gone"], summarize_group), spark=spark) == [{"gone": None, "total": 15, "count": 5}]


def test_map_overwrites_in_place(spark, tmp_path):
    rows = [{"event_type": "buy", "user_id": 7, "x": 1}]
    got = wl.execute(Map(Input(lines(tmp_path / "r.jsonl", rows)), table_ops.scale_user), spark=spark)
    assert got == [{"event_type": "buy", "user_id": 70, "x": 1}] and list(got[0]) == ["event_type", "user_id", "x"]


@pytest.fixture
def own_udfs(tmp_path, monkeypatch):
    """A module of functions with open results, next to the shipped ones."""
    import udfs

    (tmp_path / "more_udfs").mkdir()
    (tmp_path / "more_udfs" / "extra.py").write_text(
        "def sometimes(row):\n    return {'value': None} if row['value'] == 1 else ({'value': 'two', 'n': [row['value']]} if row['value'] == 2 else {})\n"
        "def truth(row):\n    return row['keep']\n"
        "def first_key(rows):\n    return {'k': 'over', 'n': len(rows)}\n"
        "def bad(row):\n    return 5\n"
    )
    monkeypatch.setattr(udfs, "__path__", [*udfs.__path__, str(tmp_path / "more_udfs")])
    yield tmp_path
    sys.modules.pop("udfs.extra", None)


def test_open_results_and_truth(spark, own_udfs, tmp_path, monkeypatch):
    # Workers find the folder as part of the udfs package only when it is shipped; here by value.
    import importlib

    from pyspark import cloudpickle

    extra = importlib.import_module("udfs.extra")
    cloudpickle.register_pickle_by_value(extra)
    monkeypatch.setattr(wl.UdfSpec, "load", lambda self, _m={n: getattr(extra, n) for n in ("sometimes", "truth", "first_key", "bad")}: _m[self.name])
    cloudpickle.register_pickle_by_value(sys.modules["weftline.plans.nodes"])
    try:
        data = Input(lines(tmp_path / "r.jsonl", [{"value": 1, "keep": "false"}, {"value": 2, "keep": ""}, {"value": 3, "keep": [0]}]))
        got = wl.execute(Map(data, extra.sometimes), spark=spark)
        assert [r["value"] for r in got] == [None, "two", 3] and [r["n"] for r in got] == [None, [2], None]
        assert [r["value"] for r in wl.execute(Filter(data, extra.truth), spark=spark)] == [1, 3]
        assert wl.execute(Reduce(Map(data, annotate), "label", extra.first_key), spark=spark)[0] == {"label": "v1", "k": "over", "n": 1}
        with pytest.raises(Exception, match="mapping"):
            wl.execute(Map(data, extra.bad), spark=spark)
    finally:
        cloudpickle.unregister_pickle_by_value(extra)
        cloudpickle.unregister_pickle_by_value(sys.modules["weftline.plans.nodes"])


class Fake(Backend):
    def open(self, source, start, end):
        first = 0 if start is None else int(start * 10)
        frames = ["dog", "cat+dog", "", "dog"][:: 1 if start is None else 2]

        class Frames(list):
            start_frame = first

        return Frames(frames)

    def detector(self, model, classes):
        return lambda frame: [(k, [0, 0, 1, 1], 0.5) for k in frame.split("+") if k in classes]


def test_detect(spark, tmp_path):
    data = Input(lines(tmp_path / "r.jsonl", [{"v": {"path": "a.mp4"}}, {"v": {"source": "b", "start": 2, "end": 4}}]))
    got = wl.execute(Detect(data, "v", ["dog", "cat"]), spark=spark, backend=Fake())
    assert [(d["type"], [b["frame_idx"] for b in d["bboxes"]]) for d in got[0]["detections"]] == [("dog", [0, 1, 3]), ("cat", [1])]
    assert [b["frame_idx"] for b in got[1]["detections"][0]["bboxes"]] == [20]
    assert wl.execute(Detect(data, "v", ["cow"], output_field="v"), spark=spark, backend=Fake()) == [{"v": []}, {"v": []}]
    with pytest.raises(QueryValidationError):
        wl.execute(Detect(data, "none", ["dog"]), spark=spark, backend=Fake())


def model(plan, rows):
    """The semantics in a few lines of Python."""
    for node in plan.chain()[1:]:
        f = node.spec.load() if isinstance(node.spec, wl.UdfSpec) else None
        if node.kind == "map":
            rows = [{**r, **f(dict(r))} for r in rows]
        elif node.kind == "filter":
            rows = [r for r in rows if f(r)]
        elif node.kind == "unnest":
            out = []
            for r in rows:
                items = r.get(node.field)
                items = items if isinstance(items, list) else [] if items is None else [items]
                out += [{**r, node.field: x} for x in items or ([None] if node.keep_empty else [])]
            rows = out
        else:
            groups = {}
            for r in rows:
                groups.setdefault(tuple(r.get(k) for k in node.group_by), []).append(r)
            rows = [{**dict(zip(node.group_by, k)), **f(g)} for k, g in groups.items()]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_against_the_model(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [{"value": draw.randint(-5, 9), "tags": draw.choice([None, [], ["a"], ["a", "b", "a"]])} for _ in range(draw.randint(1, 12))]
    plan = Input(lines(tmp_path / "r.jsonl", rows))
    for _ in range(draw.randint(1, 4)):
        plan = draw.choice([lambda p: Map(p, add_bucket), lambda p: Map(p, annotate), lambda p: Filter(p, keep_large), lambda p: Unnest(p, "tags", keep_empty=draw.random() < 0.5)])(plan)
    if draw.random() < 0.6:
        plan = Reduce(plan, draw.choice(["tags", ["value", "tags"]]) if any(n.kind == "unnest" for n in plan.chain()) else "value", summarize_group)
    for native in (True, False):
        assert wl.execute(plan, spark=spark, native=native) == model(plan, rows)


def test_filters_reach_the_scan(spark):
    from weftline.operators.compiler import compile_query

    plan = Filter(Map(Input("/root/testdata/sf0.001/events.parquet"), table_ops.bucket_user), table_ops.known_user)
    import weftline.queries  # noqa: F401  registers the column form of known_user

    df = compile_query(plan, spark, ordered=False).select("event_id", "bucket")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,2)" in text
    assert "props" not in text and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from weftline.sources.shared import shared_dir

    def session(master, named=None, held=None):
        set_ = []
        scala = SimpleNamespace(isDefined=lambda: bool(held or set_), get=lambda: (set_ or [held])[-1])
        context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {}, setCheckpointDir=set_.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: scala)))
        return SimpleNamespace(sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, named="hdfs://x/y")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")).startswith("file:/") and shared_dir(session("yarn", held="s3a://b/c")) == "s3a://b/c"


def test_bad_json_is_named_with_its_line(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a": oops\n')
    with pytest.raises(Exception, match=r"invalid JSON in .*r\.jsonl at line 4 from byte 0: \{\"a\": oops"):
        wl.execute(Input(str(path)), spark=spark)


def test_paths_belong_to_sparks_file_system(spark, tmp_path):
    path = lines(tmp_path / "r.jsonl", [{"a": 1}])
    assert wl.execute(Input(f"file://{path}"), spark=spark) == [{"a": 1}]
    with pytest.raises(QueryValidationError, match="no input"):
        wl.execute(Input(str(tmp_path / "none.jsonl")), spark=spark)


def test_field_names_that_look_like_types(spark, tmp_path):
    rows = [{"OBJECT<x": 1, "b": {"c": [1, 2]}}]
    assert wl.execute(Input(lines(tmp_path / "r.jsonl", rows)), spark=spark) == rows


def test_results_without_a_json_form_are_errors(spark, tmp_path):
    import datetime

    data = Input(lines(tmp_path / "r.jsonl", [{"event_id": 1, "k": 1}, {"event_id": 5, "k": 1}]))
    from weftline.operators.compiler import _plain

    with pytest.raises(TypeError, match="declare"):
        json.dumps({"day": datetime.date(2020, 1, 2)}, default=_plain)
    # Declared results of reducers keep their types.
    assert wl.execute(Reduce(data, "k", table_ops.sum_ids), spark=spark, native=False) == [{"k": 1, "total": 6, "count": 2}]
    assert wl.execute(Reduce(Filter(data, table_ops.never), "_all", table_ops.sum_ids), spark=spark, native=False) == [{"total": None, "count": 0}]
    assert wl.execute(Reduce(data, "k", table_ops.count_rows), spark=spark) == [{"k": 1, "count": 2}]
