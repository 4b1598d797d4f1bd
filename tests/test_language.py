"""Plans, schemas, text form, rewriting and the catalogue; no Spark needed."""

import textwrap
from pathlib import Path

import pytest

import weftline as wl
from udfs.test_ops import add_bucket, annotate
from weftline import Detect, Filter, ForEach, Input, Map, QueryValidationError, Record, Reduce, Unnest
from weftline.plans.schema import expand_output_schema, normalize_output_schema, to_struct_type

QUERY = textwrap.dedent('''
    """What it does."""
    from weftline import Input, Map, Reduce, Record, ForEach
    from udfs.test_ops import annotate

    docs = Input("docs.jsonl")
    mapped = Map(docs, ["Summarize ", Record["title"]["main"], "\\n"], schema={"summary": "string"}, name="sum")
    labelled = Map(mapped, annotate)
    output = Reduce(labelled, "_all", ["All:\\n", ForEach(["- ", Record["summary"], "\\n"])], schema={"report": {"type": "array", "items": "string"}})
''')


def test_text_is_a_fixpoint():
    program = wl.load_query(QUERY)
    text = wl.render_query(program)
    again = wl.load_query(text)
    assert again.assignments == program.assignments
    assert wl.render_query(again) == text
    assert program.input_paths() == ("docs.jsonl",)
    assert [u.name for u in program.used_udfs()] == ["annotate"]


def test_plan_gets_names():
    plan = Filter(Map(Input("data/docs.jsonl"), annotate), ["Keep ", Record["label"]])
    text = wl.render_query(plan)
    assert "from udfs.test_ops import annotate" in text
    assert 'source_docs = Input("data/docs.jsonl")' in text
    assert 'output = Filter(step_1, ["Keep ", Record["label"]])' in text


def test_detect_and_odd_characters_round_trip():
    plan = Unnest(Detect(Input("a.jsonl"), "video", ["dog", 'a "b"\x00\x7f é'], output_field="found"), "found", keep_empty=True)
    assert wl.parse_query(wl.render_query(plan)).output_expr == plan


def test_first_binding_names_a_source():
    program = wl.parse_query('a = Input("x.json")\nm = Unnest(a, "t")\nb = Input("x.json")\no = Unnest(m, "u")')
    again = wl.parse_query(wl.render_query(program))
    assert again.output_expr == program.output_expr


@pytest.mark.parametrize(
    "text",
    [
        "for i in range(3):\n    pass",
        'import os\nx = Input("a.json")',
        'from os import path\nx = Input("a.json")',
        'from udfs_other.x import f\nx = Input("a.json")',
        'from weftline import Input as I\nx = I("a.json")',
        'x = Input("a.csv")',
        'x = Input("a.json")\ny = Map(x, lambda r: r)',
        'x = Input("a.json")\ny = Map(Input("b.json"), "p", schema={})',
        'x = Input("a.json")\ny = Map(x, "p")',
        'x = Input("a.json")\ny = Filter(x, "p", schema={"a": "string"})',
        'x = Input("a.json")\ny = Map(x, "p", **{"schema": {}})',
        'x = Input("a.json")\ny = Map(x, [ForEach(["a"])], schema={"a": "string"})',
        'x = Input("a.json")\ny = Reduce(x, "_all", [Record["a"]], schema={"a": "string"})',
        'x = Input("a.json")\ny = Map(x, [Record], schema={"a": "string"})',
        'x = Input("a.json")\ny = Unnest(x, "a", keep_empty=1)',
        'x = y = Input("a.json")',
        "",
        '"""only words"""',
    ],
)
def test_outside_of_the_language(text):
    with pytest.raises(QueryValidationError):
        wl.parse_query(text)


def test_constructors_check():
    with pytest.raises(TypeError):
        Input("a.csv")
    with pytest.raises(TypeError):
        Map(Input("a.json"), "p")
    with pytest.raises(TypeError):
        Map(Input("a.json"), annotate, schema={"a": "string"})
    with pytest.raises(QueryValidationError):
        Map(Input("a.json"), lambda r: r)
    with pytest.raises(QueryValidationError):
        Reduce(Input("a.json"), [], annotate)
    with pytest.raises(TypeError):
        Reduce(Input("a.json"), 3, annotate)
    with pytest.raises(TypeError):
        Detect(Input("a.json"), "v", [])
    with pytest.raises(TypeError):
        Record[""]
    with pytest.raises(QueryValidationError):
        ForEach([ForEach(["a"])])
    with pytest.raises(QueryValidationError):
        wl.DetectSpec("v", ())


def test_schemas():
    legacy = {"type": "object", "properties": {"b": {"type": "string"}, "a": "number"}, "required": ["a", "b"]}
    assert normalize_output_schema(legacy) == {"b": "string", "a": "number"}
    assert expand_output_schema({"b": "string", "a": {"type": "array", "items": {"type": "integer"}}})["required"] == ["a", "b"]
    with pytest.raises(TypeError):
        normalize_output_schema({**legacy, "required": ["a"]})
    with pytest.raises(TypeError):
        normalize_output_schema({"a": ""})
    kinds = to_struct_type({"a": "integer", "b": {"type": "array", "items": "string"}, "c": {"type": ["string", "null"]}, "d": {"enum": [1]}, "e": {"type": "object", "properties": {"x": "number"}}})
    assert kinds.simpleString() == "struct<a:bigint,b:array<string>,c:string,d:variant,e:struct<x:double>>"


def test_cache_keys_and_hashes():
    one, other = wl.PromptSpec(("p",), {"a": "string"}), wl.PromptSpec(("p",), {"b": "string"})
    assert one.cache_key() == "p" == other.cache_key() and one != other
    nested = wl.PromptSpec(("a", Record["x"]["y"], ForEach(["b", Record["z"]])))
    assert nested.cache_key() == ("a", ("record", ("x", "y")), ("foreach", ("b", ("record", ("z",)))))
    assert len({one, wl.PromptSpec(("p",), {"a": "string"})}) == 1


def test_optimize_keeps_the_plan():
    plan = Filter(Map(Input("a.json"), annotate), "keep?")
    assert wl.optimize(plan) == plan == wl.canonicalize(plan)


def test_rewrite():
    text = 'from weftline import Input, Unnest\ndata = Input("a.json")\nout = Unnest(data, "t")'
    client = wl.StaticLLMClient(f"Here it is:\n```python\n{text}\n```\nDone.")
    assert wl.load_query(wl.rewrite(text, client, "less work")).output_expr == wl.load_query(text).output_expr
    assert "less work" in client.prompts[0]
    with pytest.raises(QueryValidationError):
        wl.rewrite(text, wl.StaticLLMClient(text.replace("a.json", "b.json")))
    with pytest.raises(SyntaxError):
        wl.rewrite(text, wl.StaticLLMClient("no code at all"))


def test_rewrite_logs_its_prompt(caplog):
    text = 'from weftline import Input\nout = Input("a.json")'
    with caplog.at_level("DEBUG", logger="weftline.plans.rewrite"):
        wl.rewrite(text, wl.StaticLLMClient(text), "less work")
    assert "less work" in caplog.text and 'Input("a.json")' in caplog.text


def test_constructors_bring_schemas_to_the_short_form():
    long = {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}
    assert Map(Input("a.json"), "p", schema=long).spec.output_schema == {"a": "string"}


def test_catalog(tmp_path: Path):
    (tmp_path / "udfs").mkdir()
    (tmp_path / "udfs" / "a.py").write_text('def f(row):\n    """Code."""\n\nasync def g(row): ...\n\nclass C: ...\n')
    (tmp_path / "udfs" / "a.pyi").write_text('def f(row: dict) -> bool: ...\ndef h(row: dict) -> dict:\n    """Planned."""\n')
    found = wl.discover_udfs(tmp_path / "udfs")
    f, h = found.get("udfs.a", "f"), found.get("udfs.a", "h")
    assert (f.signature, f.docstring, f.implemented) == ("def f(row: dict) -> bool", "Code.", True)
    assert (h.docstring, h.implemented) == ("Planned.", False)
    assert found.get("udfs.a", "C") is None and found.get("udfs.a", "g").signature.startswith("async def")


def test_udf_spec():
    spec = wl.UdfSpec("udfs.test_ops", "add_bucket")
    assert spec.load() is add_bucket
    with pytest.raises(AttributeError):
        wl.UdfSpec("udfs.test_ops", "nothing").load()
