"""The Gemini executor with a fake client, prompt text, and video helpers without OpenCV."""

import pickle
from types import SimpleNamespace

import pytest

import weftline as wl
from weftline import GeminiPromptExecutor, PromptSpec, QueryValidationError, Record, ResolvedPrompt
from weftline.functions.prompts import look_up, resolve_prompt, value_text
from weftline.operators.detect import detect_frames, detect_row, video_source
from weftline.operators.gemini import view_metadata
from weftline.sources import video as V


class Types:
    class _Any:
        def __init__(self, **values):
            self.__dict__.update(values)
            self.values = values

        def __repr__(self):
            return f"{type(self).__name__}({self.values})"

    Part = type("Part", (_Any,), {})
    Content = type("Content", (_Any,), {})
    FileData = type("FileData", (_Any,), {})
    Blob = type("Blob", (_Any,), {})
    VideoMetadata = type("VideoMetadata", (_Any,), {})


class Client:
    def __init__(self, text, states=("ACTIVE",)):
        self.calls, self.uploaded, self.states = [], [], list(states)
        self.models = SimpleNamespace(generate_content=self._generate)
        self.files = SimpleNamespace(upload=self._upload, get=lambda name: self._file())
        self.text = text

    def _generate(self, **call):
        self.calls.append(call)
        return SimpleNamespace(text=self.text)

    def _file(self):
        return SimpleNamespace(name="f", uri="uploaded://f", mime_type="video/mp4", state=SimpleNamespace(name=self.states.pop(0)))

    def _upload(self, file):
        self.uploaded.append(file)
        return self._file()


def ask(client, *parts, op="map"):
    executor = GeminiPromptExecutor(client=client, types_module=Types, poll_interval_seconds=0)
    schema = None if op == "filter" else {"summary": "string"}
    return executor, executor.execute(op, PromptSpec(("p",), schema), ResolvedPrompt(parts), {}, {})


def test_text_parts_join_and_schema():
    client = Client('{"summary": "done"}')
    _, answer = ask(client, "a ", 1, None, True, {"b": [1, "é"]}, {"type": "VIDEO", "uri": "https://v"}, "end")
    parts = client.calls[0]["contents"].parts
    assert answer == {"summary": "done"}
    assert parts[0].text == 'a 1nulltrue{"b": [1, "\\u00e9"]}' and parts[1].file_data.file_uri == "https://v" and parts[2].text == "end"
    assert client.calls[0]["config"]["response_json_schema"] == {"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"]}
    client = Client("true")
    assert ask(client, "q", op="filter")[1] is True
    assert client.calls[0]["config"]["response_json_schema"] == {"type": "boolean"}


def test_uploads_once_and_waits():
    client = Client('{"summary": ""}', ["PROCESSING", "ACTIVE"])
    executor, _ = ask(client, {"type": "Video", "path": "/tmp/a.mp4"}, {"type": "VideoView", "source": "file:///tmp/a.mp4", "start": 3, "end": 9})
    assert client.uploaded == ["/tmp/a.mp4"]
    assert client.calls[0]["contents"].parts[1].video_metadata.values == {"start_offset": "3s", "end_offset": "9s"}
    with pytest.raises(QueryValidationError):
        ask(Client("{}", ["FAILED"]), {"type": "video", "path": "x"})


def test_video_forms_and_errors():
    client = Client("{}")
    ask(client, {"type": "video", "bytes": b"1", "mime_type": "video/mp4"}, {"type": "video", "source": "https://s"})
    assert client.calls[0]["contents"].parts[0].inline_data.data == b"1"
    for bad in ({"type": "video", "bytes": b"1"}, {"type": "video"}, {"type": "video", "uri": "u", "start": 1, "start_offset": "1s"}, {"type": "video", "uri": "u", "fps": True}, {"type": "video", "uri": "u", "end_offset": 3}):
        with pytest.raises(QueryValidationError):
            ask(Client("{}"), bad)
    for text in ("", "no json", None):
        with pytest.raises(QueryValidationError):
            ask(Client(text), "p")
    assert view_metadata({"start": 10, "end": 20.5, "fps": 2}) == {"start_offset": "10s", "end_offset": "20.5s", "fps": 2.0}


def test_executor_is_pickled_without_its_lock():
    assert pickle.loads(pickle.dumps(GeminiPromptExecutor(model="m"))).model == "m"


def test_caching_executor_asks_once():
    asked = []
    inner = wl.StaticPromptExecutor({("map", "p"): lambda r, p, c: asked.append(1) or {"n": len(asked)}})
    cached = wl.CachingPromptExecutor(inner, limit=1)
    call = lambda *parts: cached.execute("map", PromptSpec(("p",), {}), ResolvedPrompt(parts), {}, {})
    assert call("a") == call("a") == {"n": 1} and call("b") == {"n": 2} and call("a") == {"n": 3}
    with pytest.raises(QueryValidationError):
        inner.execute("filter", PromptSpec(("p",)), ResolvedPrompt(("p",)), {}, {})


def test_resolution():
    spec = PromptSpec(("a", Record["x"]["y"]))
    assert resolve_prompt(spec, {"x": {"y": None}}, grouped=False).parts == ("a", None)
    with pytest.raises(QueryValidationError):
        look_up({"x": {}}, ("x", "y"))
    with pytest.raises(QueryValidationError):
        value_text(b"x")
    each = PromptSpec(("h", wl.ForEach([Record["x"], ";"])))
    assert resolve_prompt(each, [{"x": 1}, {"x": 2}], grouped=True).parts == ("h", 1, ";", 2, ";")


def test_video_sources_and_frames():
    assert video_source({"uri": "u", "path": 3, "source": "s"}) == "s" and video_source({"uri": "u", "source": None}) == "u"
    for bad in ({}, {"path": 1}, 5):
        with pytest.raises(QueryValidationError):
            video_source(bad)
    with pytest.raises(QueryValidationError):
        detect_row({"v": None}, wl.DetectSpec("v", ("a",)), wl.Backend(), lambda f: [])
    assert detect_frames(["x"], lambda f: []) == []


@pytest.mark.parametrize("fps,frames,start,end,want", [(30, 300, 1, 3, (30, 90, 60)), (10, 100, 2, 5, (20, 50, 30)), (30, 100, 0, 999, (0, 100, 100)), (30, 300, 5, 5, (150, 150, 0)), (0, 300, 1, 2, (30, 60, 30))])
def test_view_frames(fps, frames, start, end, want):
    view = V.VideoView(SimpleNamespace(fps=fps, num_frames=frames, width=1), start, end)
    assert (view.start_frame, view.end_frame, len(view)) == want and view.width == 1


def test_paths_and_downloads(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    assert V.local_path("file:///a/b%20c.mp4").as_posix() == "/a/b c.mp4" and V.local_path("x.mp4").name == "x.mp4"
    assert V.is_direct_url("https://h/p.MP4?x=1") and not V.is_direct_url("https://h/watch?v=1.mp4")
    url = "https://h/clip.mp4"
    assert V.cache_path(url).name == "clip.mp4" and V.cache_path(url) != V.cache_path(url + "?2") and V.cache_path("https://h/").name == "video"
    import io

    opened = []
    monkeypatch.setattr(V, "urlopen", lambda u: opened.append(u) or io.BytesIO(b"data"))
    assert V.local_path(url).read_bytes() == b"data" and V.local_path(url) and opened == [url]


def test_folder_is_sorted(tmp_path, monkeypatch):
    for name in ("b.mp4", "a.MOV", "c.txt"):
        (tmp_path / name).write_text("")
    monkeypatch.setattr(V, "Video", lambda p: p)
    assert [p.name for p in wl.open_video(str(tmp_path))] == ["a.MOV", "b.mp4"] or [p.name for p in V.open_video(str(tmp_path))] == ["a.MOV", "b.mp4"]


def test_whole_seconds_have_no_fraction(spark):
    from pyspark.sql import functions as F

    from weftline.functions.video_math import offset_text

    assert view_metadata({"start": 10.0, "end": 20.5}) == {"start_offset": "10s", "end_offset": "20.5s"}
    found = spark.createDataFrame([(10.0,), (20.5,), (1e7,), (123456789.0,), (None,)], "s double").select(offset_text(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in found] == ["10s", "20.5s", "10000000s", "123456789s", None]


class Cv2:
    """A stand-in for OpenCV: a video of numbered frames, ten a second."""

    CAP_PROP_FRAME_WIDTH, CAP_PROP_FRAME_HEIGHT, CAP_PROP_FRAME_COUNT, CAP_PROP_FPS, CAP_PROP_POS_FRAMES = range(5)

    def __init__(self, frames=100):
        self.frames, self.opened, self.released, self.seeks = frames, 0, 0, []

    def VideoCapture(self, path):
        cv2 = self
        cv2.opened += 1

        class Capture:
            at = 0

            def isOpened(self):
                return "missing" not in path

            def get(self, what):
                return (64.0, 48.0, float(cv2.frames), 10.0)[what]

            def set(self, what, value):
                assert what == cv2.CAP_PROP_POS_FRAMES
                cv2.seeks.append(value)
                self.at = value

            def read(self):
                self.at += 1
                return (True, f"frame {self.at - 1}") if self.at <= cv2.frames else (False, None)

            def release(self):
                cv2.released += 1

        return Capture()


def test_videos_are_read_and_released(monkeypatch):
    cv2 = Cv2(5)
    monkeypatch.setattr(V, "_cv2", lambda: cv2)
    video = V.Video("a.mp4")
    assert (video.width, video.height, video.num_frames, video.fps, len(video)) == (64, 48, 5, 10.0, 5)
    assert list(video) == list(video) == [f"frame {i}" for i in range(5)]
    first = iter(video)
    next(first)
    first.close()  # a reader that stops early lets go of the file as well
    assert cv2.opened == cv2.released == 4
    with pytest.raises(ValueError):
        V.Video("missing.mp4")
    assert cv2.opened == cv2.released == 5


def test_views_seek_and_stop(monkeypatch):
    cv2 = Cv2()
    monkeypatch.setattr(V, "_cv2", lambda: cv2)
    view = V.VideoView(V.Video("a.mp4"), 2.0, 2.2)
    assert list(view) == ["frame 20", "frame 21"] and cv2.seeks == [20]
    assert list(V.VideoView(V.Video("a.mp4"), 9.8, 99)) == ["frame 98", "frame 99"]
    assert list(V.VideoView(V.Video("a.mp4"), 3, 3)) == [] and cv2.opened == cv2.released
    row = {"v": {"type": "VideoView", "source": "file:///a.mp4", "start": 2.0, "end": 2.2}}
    found = detect_row(row, wl.DetectSpec("v", ("dog",)), wl.Backend(), lambda frame: [("dog", [0, 0, 1, 1], 0.9)])
    assert [b["frame_idx"] for b in found[0]["bboxes"]] == [20, 21]


def test_detector_of_the_model_library(monkeypatch):
    import sys

    from weftline.operators import detect as D

    class Numbers(list):
        def tolist(self):
            return list(self)

    class Model:
        def __init__(self, name):
            self.name, self.sets = name, []

        def to(self, device):
            self.device = device

        def get_text_pe(self, names):
            return f"pe of {names}"

        def set_classes(self, names, pe):
            self.sets.append((names, pe))

        def predict(self, frame, verbose, device):
            boxes = SimpleNamespace(cls=[0.0], xyxy=[Numbers([1, 2, 3, 4])], conf=[0.75])
            return [SimpleNamespace(boxes=boxes, names={0: "dog"}), SimpleNamespace(boxes=None, names={})]

    monkeypatch.setitem(sys.modules, "ultralytics", SimpleNamespace(YOLOE=Model))
    monkeypatch.setattr(D, "_MODELS", {})
    assert list(wl.Backend().detector("w.pt", ["dog"])("frame")) == [("dog", [1, 2, 3, 4], 0.75)]
    held, _ = D._MODELS["w.pt"]
    wl.Backend().detector("w.pt", ["cat"])
    assert D._MODELS["w.pt"][0] is held and held.sets[-1] == (["cat"], "pe of ['cat']")


def test_platform_downloads_are_whole(tmp_path, monkeypatch):
    import sys

    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    asked = []

    class Loader:
        def __init__(self, options):
            self.out = options["outtmpl"]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def download(self, urls):
            asked.append(urls)
            if "none" not in urls[0]:
                with open(self.out.replace("%(id)s", "x").replace("%(ext)s", "mp4"), "wb") as file:
                    file.write(b"v")

    monkeypatch.setitem(sys.modules, "yt_dlp", SimpleNamespace(YoutubeDL=Loader))
    url = "https://h/watch?v=1"
    assert V.local_path(url).name == "x.mp4" and V.local_path(url).read_bytes() == b"v" and asked == [[url]]
    with pytest.raises(RuntimeError):
        V.local_path("https://h/none")
    assert [p.name for p in V.cache_root().iterdir()] == [V.cache_path(url).parent.name]


def test_a_slow_upload_does_not_stop_others():
    import threading

    client = Client("{}", ["ACTIVE"] * 2)
    slow, begun, go_on = client._upload, threading.Event(), threading.Event()

    def upload(file):
        if file == "slow.mp4":
            begun.set()
            assert go_on.wait(20)
        return slow(file)

    client.files.upload = upload
    executor = GeminiPromptExecutor(client=client, types_module=Types, poll_interval_seconds=0)
    run = lambda path: executor.execute("map", PromptSpec(("p",), {}), ResolvedPrompt(({"type": "video", "path": path},)), {}, {})
    thread = threading.Thread(target=run, args=("slow.mp4",))
    thread.start()
    assert begun.wait(20)
    run("fast.mp4")
    assert client.uploaded == ["fast.mp4"]
    go_on.set()
    thread.join()
    run("slow.mp4")
    assert client.uploaded == ["fast.mp4", "slow.mp4"]


def test_answers_outlive_the_executor():
    asked = []
    handlers = {("map", "p"): lambda r, p, c: asked.append(1) or {"n": len(asked)}}
    first = wl.CachingPromptExecutor(wl.StaticPromptExecutor(handlers), name="of this test")
    again = wl.CachingPromptExecutor(wl.StaticPromptExecutor(handlers), name="of this test")  # as a task's copy
    for executor in (first, again):
        assert executor.execute("map", PromptSpec(("p",), {}), ResolvedPrompt(("a",)), {}, {}) == {"n": 1}
