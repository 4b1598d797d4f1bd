"""Rows in buckets, their tags counted.  Runs in both forms: text and expr."""

from weftline import Input, Map, Filter, Reduce, Unnest
from udfs.test_ops import add_bucket, keep_large, summarize_group

rows = Input("examples/rows.jsonl")
bucketed = Map(rows, add_bucket)
large = Filter(bucketed, keep_large)
tagged = Unnest(large, "tags", keep_empty=True)
output = Reduce(tagged, ["bucket", "tags"], summarize_group)
