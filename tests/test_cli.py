"""The runner in both forms, and the image detector with a fake model."""

import json
from types import SimpleNamespace

import weftline as wl
from udfs.detect import ImageDetector, detect
from weftline.__main__ import main


def test_both_forms(spark, capsys, monkeypatch):
    from .conftest import ROOT

    monkeypatch.chdir(ROOT)
    results = []
    for form in ("text", "expr"):
        assert main([form, "examples/buckets.py"]) == 0
        results.append([json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert results[0] == results[1] == [{"bucket": 1, "tags": "c", "total": 2, "count": 1}, {"bucket": 2, "tags": None, "total": 4, "count": 1}]


def test_examples_parse():
    from .conftest import ROOT

    for path in sorted((ROOT / "examples").glob("*.py")):
        program = wl.load_query(path)
        assert wl.load_query(wl.render_query(program)).output_expr == program.output_expr


def test_image_detector():
    class Model:
        classes = None

        def get_text_pe(self, names):
            return names

        def set_classes(self, names, _):
            self.classes = names

        def predict(self, image, verbose):
            boxes = SimpleNamespace(cls=[1.0], xyxy=[[0, 1, 2, 3]], conf=[0.5])
            return [SimpleNamespace(boxes=boxes, names={1: "dog"}), SimpleNamespace(boxes=None, names={})]

    model = Model()
    found = ImageDetector("detect", lambda: model)({"image": "a.png", "classes": ["dog"]})
    assert found == {"detections": [{"bbox": [0.0, 1.0, 2.0, 3.0], "confidence": 0.5, "class_id": 1, "class_name": "dog"}]}
    assert model.classes == ["dog"]
    assert wl.Map(wl.Input("a.jsonl"), detect).spec == wl.UdfSpec("udfs.detect", "detect")
    assert wl.UdfSpec("udfs.detect", "detect").load() is detect
