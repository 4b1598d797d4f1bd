"""Each detection in the clips as a row of its own; needs the media packages (ultralytics, opencv)."""

from weftline import Input, Detect, Unnest

clips = Input("examples/clips.jsonl")
boxed = Detect(clips, "video", ["bear", "deer"], output_field="seen")
output = Unnest(boxed, "seen")
