"""Species in wildlife clips, counted by name; needs a prompt executor (--gemini)."""

from weftline import Input, Map, Reduce, Unnest, Record, ForEach

clips = Input("examples/clips.jsonl")
seen = Map(clips, ["Which animal species does this clip show? ", Record["video"]], schema={"species": {"type": "array", "items": {"type": "string"}}})
each = Unnest(seen, "species")
output = Reduce(each, "species", ["How many clips are listed, and which?\n", ForEach(["- ", Record["title"], "\n"])], schema={"clips": "integer", "titles": "string"})
