"""What the two substring operators share: leaders that repeat, and copies of whole texts.

A leader is the hash of a part that stands for the windows around it: equal
windows have equal leaders.  Before the exchange a task settles what it can
among its own rows, so a leader that a third of all documents share reaches its
reducer twice per task and not once per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, left_join_spread, materialise, partitions, text_slices

#: Stands for a null doc_id: smaller than any other.
NULL_DOC = -(1 << 63)
#: A task settles its own rows in portions of so many.
PORTION = 1_000_000


def with_identity(docs: DataFrame, others: list[str] | None = None) -> DataFrame:
    """doc (never null), text, text_hash; doc and text_hash together name a row.  others: columns to take along, as _w_c0, ..."""
    text = F.col("text").cast("string")
    along = [F.col(c).alias(f"_w_c{i}") for i, c in enumerate(others or [])]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc"), text.alias("text"), F.xxhash64(F.lit(3), F.coalesce(text, F.lit(""))).alias("text_hash"), *along)


def doc_id() -> Column:
    """The doc_id of a row of ``with_identity``; read from doc, so that every use of the texts asks for the same columns and shares one exchange."""
    return F.when(F.col("doc") != NULL_DOC, F.col("doc")).alias("doc_id")


def spread(key: str = "key") -> Column:
    """Where a row goes: settled ones by document, so they share no reducer."""
    return F.when(F.col("settled"), F.xxhash64("doc", "text_hash")).otherwise(F.col(key))


def copies(own: DataFrame) -> DataFrame:
    """doc, text_hash, is_copy of the texts that a smaller doc_id has too; two hashes and the length tell texts apart."""
    narrow = own.select("doc", "text_hash", F.xxhash64(F.lit(4), "text").alias("_w_h"), F.octet_length("text").cast("long").alias("_w_b")).where("_w_b > 0")
    narrow = materialise(narrow, "text-hashes")
    least = narrow.groupBy(F.col("text_hash").alias("_w_k0"), F.col("_w_h").alias("_w_k1"), F.col("_w_b").alias("_w_k2")).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("_w_n")).where("least < most")
    told = left_join_spread(narrow, materialise(least, "text-groups"), [F.col("text_hash"), F.col("_w_h"), F.col("_w_b")], narrow.count(), ["least"])
    return told.where("doc > least").select("doc", "text_hash").distinct().withColumn("is_copy", F.lit(True))


def shared_leaders(own: DataFrame, leaders_of: Callable[[list[bytes]], Iterable[np.ndarray]], crowd: int | None = None) -> DataFrame:
    """doc, text_hash, leaders: the leaders of a text that occur elsewhere too; with ``crowd`` also crowded: those that more texts have."""
    lead = own.select("doc", "text", "text_hash").mapInArrow(send_leaders(leaders_of), LEAD)
    dealt = lead.repartition(partitions(own.sparkSession), spread()).sortWithinPartitions("settled", "key", "text_hash", "doc")
    found = dealt.mapInArrow(_shared_leaders, "doc long, text_hash long, key long")
    if crowd is None:
        return found.groupBy("doc", "text_hash").agg(F.collect_set("key").alias("leaders"))
    found = materialise(found, "leaders")
    n = found.count()
    many = found.groupBy(F.col("key").alias("_w_k0")).agg(F.count("*").alias("_w_n")).where(F.col("_w_n") > crowd).withColumn("_w_many", F.lit(True))
    if n <= crowd * HOT_KEYS:  # so many leaders at most are crowded
        marked = found.join(F.broadcast(many), F.col("key") == F.col("_w_k0"), "left")
    else:
        marked = left_join_spread(found, many, [F.col("key")], n, ["_w_many"])
    return marked.groupBy("doc", "text_hash").agg(F.collect_set("key").alias("leaders"), F.collect_set(F.when(F.col("_w_many"), F.col("key"))).alias("crowded"))


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, bool)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


LEAD = "key long, text_hash long, doc long, settled boolean"


def send_leaders(leaders_of: Callable[[list[bytes]], Iterable[np.ndarray]]):
    """(doc, text, text_hash) -> leaders; settled: two texts of this task share it.

    ``leaders_of`` gives each text's leader hashes; one that is given twice for
    a text counts as shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not held:
                return
            key, text, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            size = 0
            order = np.lexsort((doc, text, key))
            key, text, doc = key[order], text[order], doc[order]
            once = first_of(key, text)  # further copies of a text are dropped as such
            key, text, doc = key[once], text[once], doc[once]
            new = first_of(key)
            group = np.cumsum(new) - 1
            many = np.bincount(group) > 1
            shared = many[group]
            # A shared leader is told to the others by two rows, which are settled as well.
            nth = np.arange(len(key)) - np.flatnonzero(new)[group]
            yield _lead(key, text, doc, np.zeros(len(key), bool), ~shared | (nth < 2))
            yield _lead(key, text, doc, np.ones(len(key), bool), shared & (nth >= 2))

        for b in batches:
            docs, hashes = b.column(0).to_numpy(), b.column(2).to_numpy()
            for start, texts in text_slices(b, 1):
                for i, found in enumerate(leaders_of([(t or "").encode() for t in texts]), start):
                    if len(found):
                        lead, times = np.unique(found.view(np.int64), return_counts=True)
                        twice = lead[times > 1]
                        lead = np.concatenate([lead, twice])
                        n = len(lead)
                        text = np.full(n, hashes[i])
                        if len(twice):
                            text[-len(twice) :] ^= -1  # stands for the second place; no row has this hash
                        held.append((lead, text, np.full(n, docs[i])))
                        size += n
                if size >= PORTION:
                    yield from flush()
        yield from flush()

    return run


def _lead(key, text, doc, settled, which) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[which]) for x in (key, text, doc, settled)], names=["key", "text_hash", "doc", "settled"])


def _shared_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (settled, key, text_hash, doc): the leaders of two texts or more, one row for each text's first document."""
    last: tuple | None = None  # key, text, doc of the open group's first row; None once told
    key = text = None
    for b in batches:
        keys, texts, docs = (b.column(i).to_numpy() for i in range(3))
        settled = b.column(3).to_numpy(zero_copy_only=False)
        n = len(keys)
        if not n:
            continue
        new_key = np.r_[keys[0] != key or bool(settled[0]), keys[1:] != keys[:-1]] | settled
        new_text = new_key | np.r_[texts[0] != text, texts[1:] != texts[:-1]]
        first = np.flatnonzero(new_text)
        lone = new_key[first]
        followed = np.r_[~lone[1:], False]
        keep = (~lone | followed | settled[first])
        out = first[keep]
        early = []
        if len(first) and not lone[0] and last is not None:
            early.append(last)
            last = None
        if len(early) or len(out):
            k, t, d = (np.concatenate([np.array([e[j] for e in early], np.int64), x[out]]) for j, x in enumerate((keys, texts, docs)))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(k)], names=["doc", "text_hash", "key"])
        if len(first):
            end = first[-1]
            if lone[-1]:
                last = None if settled[end] else (keys[end], texts[end], docs[end])
            elif not lone.all():
                last = None if keep[-1] else last
        key, text = keys[-1], texts[-1]
