"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line.  A section is a run of paragraphs that ends after a
blank one or where the digest of a paragraph says so; a paragraph's pieces end
where the checksum of a word says so.  All cuts follow from the content, so an
edit moves only the cuts near it and the branches elsewhere stay equal.

The fingerprint string holds the root (128 bits: equal roots, equal texts) and
the first 32 bits of each leaf in order, so that likeness needs the strings
only: the Dice coefficient of the two multisets of leaves, 1 if and only if the
roots are equal.  ``locate_edits`` compares two trees from the root down and
opens differing branches only.

The edited text of the query needs the next document.  Rows are dealt by cut
points of (doc_id, text hash), the first rows of the partitions of a range
exchange of these two; the first row of each range is copied to the range
before it, so the texts are shuffled once, sorted and streamed in constant
memory.  Rows with one doc_id spread over as many parts as their texts need;
rows that are alike in both leave a batch as one.

Defined cases: a null text is empty; the empty text has a root and no leaf; two
empty texts have likeness 1; equal doc_ids follow each other by text hash; a
null doc_id comes first; a single document follows itself; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, documents, keyed, partitions, text_slices

#: On average, words a piece and paragraphs a section.
PIECE_WORDS = 8
SECTION_PARAGRAPHS = 4
_LEAF_HEX = 8


class Node(NamedTuple):
    digest: bytes
    children: tuple["Node", ...]
    start: int
    stop: int


def _digest(kind: bytes, content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16, person=kind).digest()


def _pieces(paragraph: bytes) -> list[bytes]:
    words = paragraph.split(b" ")
    crc, mask = zlib.crc32, PIECE_WORDS - 1
    out, begin = [], 0
    for end in [i for i, w in enumerate(words, 1) if not crc(w) & mask]:
        out.append(b" ".join(words[begin:end]))
        begin = end
    if begin < len(words):
        out.append(b" ".join(words[begin:]))
    return out


def tree(text: str | None) -> Node:
    """The tree of a text; start and stop are byte offsets."""
    raw = (text or "").encode()
    sections, held, at, begin = [], [], 0, 0
    for paragraph in raw.split(b"\n") if raw else ():
        leaves, place = [], at
        for piece in _pieces(paragraph):
            leaves.append(Node(_digest(b"piece", piece), (), place, place + len(piece)))
            place += len(piece) + 1
        stop = at + len(paragraph)
        held.append(Node(_digest(b"paragraph", b"".join(x.digest for x in leaves)), tuple(leaves), at, stop))
        at = stop + 1
        if not paragraph or not held[-1].digest[0] % SECTION_PARAGRAPHS:
            sections.append(Node(_digest(b"section", b"".join(x.digest for x in held)), tuple(held), begin, stop))
            held, begin = [], at
    if held:
        sections.append(Node(_digest(b"section", b"".join(x.digest for x in held)), tuple(held), begin, len(raw)))
    return Node(_digest(b"root", b"".join(x.digest for x in sections)), tuple(sections), 0, len(raw))


def fingerprint(text: str | None) -> str:
    """The root and the leaves' first bits, as hexadecimal digits (built level by level, without the nodes of ``tree``)."""
    raw = (text or "").encode()
    leaves, sections, held = [], [], []
    blake = hashlib.blake2b
    for paragraph in raw.split(b"\n") if raw else ():
        own = [blake(p, digest_size=16, person=b"piece").digest() for p in _pieces(paragraph)]
        leaves += own
        held.append(_digest(b"paragraph", b"".join(own)))
        if not paragraph or not held[-1][0] % SECTION_PARAGRAPHS:
            sections.append(_digest(b"section", b"".join(held)))
            held = []
    if held:
        sections.append(_digest(b"section", b"".join(held)))
    return _digest(b"root", b"".join(sections)).hex() + ":" + b"".join(x[: _LEAF_HEX // 2] for x in leaves).hex()


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprint strings."""
    root_a, _, leaves_a = a.partition(":")
    root_b, _, leaves_b = b.partition(":")
    if root_a == root_b:
        return 1.0
    x = np.frombuffer(bytes.fromhex(leaves_a), ">u4").tolist()
    y = np.frombuffer(bytes.fromhex(leaves_b), ">u4").tolist()
    if not x or not y:
        return 0.0
    shared = Counter(x)
    shared &= Counter(y)
    n = len(x) + len(y)
    return min(2 * sum(shared.values()), n - 1) / n


def locate_edits(a: Node, b: Node) -> list[tuple[int, int, int, int]]:
    """(start, stop) in the first text and in the second, for each differing branch that cannot be opened further."""
    if a.digest == b.digest:
        return []
    x, y = a.children, b.children
    head = 0
    while head < min(len(x), len(y)) and x[head].digest == y[head].digest:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].digest == y[-1 - tail].digest:
        tail += 1
    left, right = x[head : len(x) - tail], y[head : len(y) - tail]
    if left and len(left) == len(right):
        return [e for p, q in zip(left, right, strict=True) for e in locate_edits(p, q)]
    span = lambda node, all_, part: (part[0].start, part[-1].stop) if part else (all_[head].start if head < len(all_) else node.stop,) * 2
    return [(*span(a, x, left), *span(b, y, right))]


_AT = pa.schema([("part", pa.int32()), ("copy", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("times", pa.int64())])


def _place_rows(cuts: list[tuple[bool, int, int]]):
    """(doc_id, row, text) -> (part, copy, doc_id, row, text, times): rows of a batch that are alike become one.

    cuts: the first row of each part, as (has an id, doc_id, row).  The first
    rows of a part are copied to the end of the part before it, those of the
    first part to the end of the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [(d is not None, d or 0, r) for d, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            first: dict[tuple[bool, int, int], int] = {}
            for i, name in enumerate(names):
                first.setdefault(name, i)
            times = Counter(names)
            part, copy, row, n = [], [], [], []
            for name, i in first.items():
                at = max(0, bisect.bisect_right(cuts, name) - 1)
                part.append(at)
                copy.append(0)
                row.append(i)
                n.append(times[name])
                if cuts[at] == name:
                    part.append(at - 1 if at else len(cuts) - 1)
                    copy.append(1)
                    row.append(i)
                    n.append(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)[row] + 32)
            at = 0
            while at < len(row):  # copies may hold long texts, so that they go in batches of some MB as well
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (16 << 20), "right")))
                where = pa.array(row[at:stop])
                yield pa.RecordBatch.from_arrays([pa.array(part[at:stop], pa.int32()), pa.array(copy[at:stop], pa.int32()), b.column(0).take(where), b.column(1).take(where), b.column(2).take(where).cast(pa.string()), pa.array(n[at:stop], pa.int64())], schema=_AT)
                at = stop

    return run


def _with_next(docs: DataFrame) -> DataFrame:
    """part, copy, doc_id, text, times, sorted: in each part every row but the copies is followed by the next document."""
    own = keyed(docs)
    n = partitions(docs.sparkSession)
    keys = ["doc_id", ROW_KEY]
    # Cut points: the first row of each partition of the narrow rows in order.
    ranged = own.select(*keys).repartitionByRange(n, *keys)
    least = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), ROW_KEY)).alias("first"))
    cuts = sorted({(r["first"]["has"], r["first"]["doc_id"], r["first"][ROW_KEY]) for r in least.collect()})  # one row for each partition
    placed = own.select("doc_id", ROW_KEY, "text").mapInArrow(_place_rows(cuts or [(False, 0, 0)]), "part int, copy int, doc_id long, row long, text string, times long")
    return placed.repartitionById(n, "part").sortWithinPartitions("part", "copy", "doc_id", "row").select("part", "copy", "doc_id", "text", "times")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(doc: int | None, old: str, print_: str, new: str, next_print: str) -> tuple:
    half = len(old) // 2
    edited = old[: len(old) - half] + new[:half]
    of_edited = fingerprint(edited)
    return doc, len(old), hashlib.sha256(edited.encode()).hexdigest(), print_, of_edited, likeness(print_, of_edited), likeness(print_, next_print)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, copy, doc_id, text, times): each one with the next, and rows that stand for several with themselves as often as that."""
    before = None

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else None) for k, c in enumerate(zip(*out, strict=True))], names=_NAMES)

    for b in batches:
        parts, copies, ids, times = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
        for start, texts in text_slices(b, 3):
            out: list[tuple] = []
            for i, text in enumerate(texts, start):
                text = text or ""
                now = (parts[i], copies[i], ids[i], text, fingerprint(text))
                if before is not None and before[0] == now[0] and not before[1]:
                    out.append(_compared(*before[2:], *now[3:]))
                if not copies[i] and times[i] > 1:
                    same = _compared(*now[2:], *now[3:])
                    out.append(same)
                    for at in range(1, times[i] - 1, 1000):
                        if out:
                            yield batch(out)
                        out = [same] * min(1000, times[i] - 1 - at)
                before = now
            if out:
                yield batch(out)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each whole text; narrow, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array([fingerprint(t) for t in texts])], names=["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs).mapInArrow(_compare, schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir))
