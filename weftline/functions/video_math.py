"""Frame ranges and offsets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK_FPS = 30.0


def frame_range(start: Column, end: Column, fps: Column, n_frames: Column) -> dict[str, Column]:
    """start_frame, end_frame and num_frames of a time range, truncated as in ``VideoView``."""
    rate = F.when(fps != 0, fps).otherwise(F.lit(FALLBACK_FPS))
    first = (start * rate).cast("long")
    last = F.least((end * rate).cast("long"), n_frames.cast("long"))
    return {"start_frame": first, "end_frame": last, "num_frames": F.greatest(F.lit(0).cast("long"), last - first)}


def offset_text(seconds: Column) -> Column:
    """``10s``, ``20.5s``; whole seconds of any size stand in digits."""
    whole = (seconds == F.floor(seconds)) & (F.abs(seconds) < 1e18)
    return F.concat(F.when(whole, F.floor(seconds).cast("string")).otherwise(seconds.cast("string")), F.lit("s"))
