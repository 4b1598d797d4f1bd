"""Object detection on single images, as a function for Map.

A row has ``image`` (a path, or anything that the model takes) and may have
``classes``.  The model is loaded at the first call in each worker.
"""

import threading

MODEL = "yoloe-11s-seg.pt"


class ImageDetector:
    """A callable object that is imported by name like a function."""

    returns = "detections array<struct<bbox: array<double>, confidence: double, class_id: bigint, class_name: string>>"

    def __init__(self, name, load=None):
        self.__name__ = self.__qualname__ = name
        self.__module__ = __name__
        self._load, self._model, self._lock = load, None, threading.Lock()

    def _ready(self):
        if self._model is None:
            if self._load is None:
                from ultralytics import YOLOE

                self._load = lambda: YOLOE(MODEL)
            self._model = self._load()
        return self._model

    def __call__(self, row):
        with self._lock:  # the classes are set on the model, so setting and predicting belong together
            model = self._ready()
            if row.get("classes"):
                model.set_classes(list(row["classes"]), model.get_text_pe(list(row["classes"])))
            results = model.predict(row["image"], verbose=False)
        found = []
        for result in results:
            boxes = result.boxes
            if boxes is None:
                continue
            for kind, box, sure in zip(boxes.cls, boxes.xyxy, boxes.conf, strict=True):
                found.append({"bbox": [float(x) for x in box], "confidence": float(sure), "class_id": int(kind), "class_name": result.names[int(kind)]})
        return {"detections": found}


detect = ImageDetector("detect")
