"""How often each species is seen: named by a prompt, counted by a function; needs a prompt executor (--gemini)."""

from weftline import Input, Map, Reduce, Unnest, Record
from udfs.table_ops import count_rows

clips = Input("examples/clips.jsonl")
named = Map(clips, ["Name each animal species in this clip once. ", Record["video"]], schema={"species": {"type": "array", "items": {"type": "string"}}})
single = Unnest(named, "species")
output = Reduce(single, "species", count_rows)
