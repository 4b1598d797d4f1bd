"""Substring dedup: word windows that an earlier document has too are removed.

Every window of ``WINDOW`` words gets a Rabin-Karp hash.  Only windows that can
repeat are sent anywhere: each window is led by the smallest hash among its
``CORE``-word parts, equal windows have equal leaders, and a window whose
leader occurs in one text only cannot repeat.  So:

1. Leaders (about one for every 18 words) are exchanged by hash; those found in
   two different texts come back to their documents.
2. Window hashes under such leaders (two of 64 bits) are exchanged and compared:
   the smallest doc_id keeps a window, every other document loses it.  A window
   that one text holds at many places is sent once.
3. The lost windows of a document merge into maximal intervals of words.

Copies of a whole text are found by its hash; all but those with the smallest
doc_id are dropped at once, so groups of copies add no windows.

Hot keys: before each exchange a task settles what it can among its own rows.
A leader or window that many documents of a task share leaves the task once;
the settled rows go on by document.  So a passage in a third of all documents
gives its reducer one row per task, not one per document.

Texts are exchanged once, by document; both joins read that exchange.

Defined cases: null and empty texts have no words; fewer than ``WINDOW`` words
lose nothing; a window repeated inside one document only stays; rows with the
same doc_id are not earlier than each other; a null doc_id counts as the
smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, text_slices
from .repeats import PORTION, copies, doc_id, first_of, shared_leaders, spread, with_identity
from .rolling import sliding_min, windows, word_hashes

WINDOW = 50
CORE = 16


def leaders(words: np.ndarray, window: int, core: int) -> np.ndarray:
    """For each window, the smallest hash of its cores."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(windows(words, core), window - core + 1)


_OPEN = "key long, key2 long, doc long, text_hash long, at array<int>, settled boolean"
_OPEN_NAMES = ["key", "key2", "doc", "text_hash", "at", "settled"]


def _send_windows(window: int, core: int):
    """(doc, text, row, leaders, is_copy) -> hashes of windows under shared leaders; settled: an earlier document of this task has it.

    A window that a text holds at many places goes once, with all its places:
    they are lost together or stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not held:
                return
            key, key2, doc, row, at = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            size = 0
            order = np.lexsort((at, row, doc, key2, key))
            key, key2, doc, row, at = key[order], key2[order], doc[order], row[order], at[order]
            same = np.flatnonzero(first_of(key, key2, doc, row))
            places = pa.ListArray.from_arrays(pa.array(np.r_[same, len(key)], pa.int32()), pa.array(at))
            key, key2, doc, row = key[same], key2[same], doc[same], row[same]
            new = np.flatnonzero(first_of(key, key2))
            first = np.repeat(doc[new], np.diff(np.r_[new, len(key)]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key2), pa.array(doc), pa.array(row), places, pa.array(doc > first)], names=_OPEN_NAMES)

        for b in batches:
            docs, rows = b.column(0).to_numpy(), b.column(2).to_numpy()
            copies = b.column(4).to_pylist()
            for start, texts in text_slices(b, 1):
                wanted = [i for i in range(start, start + len(texts)) if b.column(3)[i].is_valid and not copies[i]]
                for i, words in zip(wanted, word_hashes([(texts[i - start] or "").encode() for i in wanted]), strict=True):
                    lead = leaders(words, window, core)
                    at = np.flatnonzero(np.isin(lead, b.column(3)[i].values.to_numpy().view(np.uint64)))
                    if len(at):
                        n = len(at)
                        both = (windows(words, window, which)[at].view(np.int64) for which in (0, 1))
                        held.append((*both, np.full(n, docs[i]), np.full(n, rows[i]), at.astype(np.int32)))
                        size += n
                    if size >= PORTION:
                        yield from flush()
        yield from flush()

    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (settled, key, key2, doc): the windows that a smaller document has, and the settled ones."""
    key, least = (None, None), 0
    for b in batches:
        keys, keys2, docs = (b.column(i).to_numpy() for i in (0, 1, 2))
        settled = b.column(5).to_numpy(zero_copy_only=False)
        n = len(keys)
        if not n:
            continue
        new = first_of(keys, keys2)
        new[0] = (keys[0], keys2[0]) != key
        bounds = np.flatnonzero(np.r_[True, new[1:]])
        firsts = docs[bounds]
        if not new[0]:
            firsts[0] = least
        first = np.repeat(firsts, np.diff(np.r_[bounds, n]))
        lost = np.flatnonzero((docs > first) | settled)
        if len(lost):
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(lost)) for i in (2, 3, 4)], names=_OPEN_NAMES[2:5])
        key, least = (keys[-1], keys2[-1]), first[-1]


def _lost(docs: DataFrame, window: int, core: int) -> DataFrame:
    """doc_id, text, starts (of lost windows), is_copy."""
    n = partitions(docs.sparkSession)
    own = with_identity(docs)
    same = ["doc", "text_hash"]

    def leaders_of(texts: list[bytes]) -> Iterator[np.ndarray]:
        for words in word_hashes(texts):
            lead = leaders(words, window, core)
            yield np.unique(lead[first_of(lead)])  # a window that repeats in one document only stays

    copied = copies(own)
    hints = shared_leaders(own, leaders_of).join(copied, same, "full")
    texts = own.repartition(n, *same)
    sent = texts.join(hints, same, "left").select("doc", "text", "text_hash", "leaders", "is_copy").mapInArrow(_send_windows(window, core), _OPEN)
    later = sent.repartition(n, spread()).sortWithinPartitions("settled", "key", "key2", "doc").mapInArrow(_later_windows, "doc long, text_hash long, at array<int>")
    starts = later.groupBy(*same).agg(F.flatten(F.collect_list("at")).alias("starts"))
    return texts.join(starts, same, "left").join(copied, same, "left").select(doc_id(), "text", "starts", "is_copy")


def removed_words(n_words: int, starts: np.ndarray | None, is_copy: bool, window: int) -> np.ndarray:
    """Which words lie in a lost window."""
    if n_words < window:
        return np.zeros(n_words, bool)
    if is_copy:
        return np.ones(n_words, bool)
    if starts is None:
        return np.zeros(n_words, bool)
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.asarray(starts) + window, -1)
    return np.cumsum(step[:-1]) > 0


def _starts(value) -> np.ndarray | None:
    return value.values.to_numpy() if value.is_valid else None


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, 1):
                n, removed, digests = [], [], []
                for i, text in enumerate(texts, start):
                    words = (text or "").encode().split()
                    gone = removed_words(len(words), _starts(b.column(2)[i]), bool(b.column(3)[i].as_py()), window)
                    n.append(len(words))
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _intervals(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, 1):
                out = []
                for i, text in enumerate(texts, start):
                    gone = removed_words(len((text or "").encode().split()), _starts(b.column(2)[i]), bool(b.column(3)[i].as_py()), window)
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    out.append([{"start": int(s), "stop": int(e)} for s, e in zip(edges[0::2], edges[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "removed"])

    return run


def removal_intervals(docs: DataFrame, window: int = WINDOW, core: int = CORE) -> DataFrame:
    """doc_id, removed: the maximal intervals of words that each document loses."""
    found = _lost(docs, window, core).select("doc_id", "text", "starts", "is_copy")
    return found.mapInArrow(_intervals(window), "doc_id long, removed array<struct<start: long, stop: long>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lost(documents(spark, sf_dir), WINDOW, CORE).select("doc_id", "text", "starts", "is_copy")
    return found.mapInArrow(_digest(WINDOW), "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP9_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, len(w) as n, w, unnest(range(1, greatest(len(w) - 48, 1))) as p from d where len(w) >= 50),
h as (select doc_id, p, array_to_string(w[p:p + 49], ' ') as win from s),
m as (select win, min(doc_id) as least from h group by win having min(doc_id) <> max(doc_id)),
r as (select distinct h.doc_id, h.p from h join m on h.win = m.win where h.doc_id > m.least),
g as (select distinct doc_id, unnest(range(p, p + 50)) as i from r),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
k as (select x.doc_id, string_agg(x.word, ' ' order by x.i) as kept from x left join g on x.doc_id = g.doc_id and x.i = g.i where g.i is null group by x.doc_id),
c as (select doc_id, count(*) as removed from g group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.removed, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join c on d.doc_id = c.doc_id left join k on d.doc_id = k.doc_id
"""
