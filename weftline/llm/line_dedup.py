"""Line dedup: frequent (or repeated) lines of a corpus, as per-document keep bitmaps.

1. Each line becomes a narrow row: 128 bits of hash of its key, the document
   and the position; no text travels.
2. The rows are range-partitioned by (hash, document) and sorted by (hash,
   document, position).  The document is part of the range key, so a line that
   a third of all documents share fills as many partitions as it needs.
3. Each partition is streamed once.  A run of equal hashes that begins and
   ends inside the partition is decided on the spot.  At most two runs per
   partition can reach over its edge; their rows are passed on as open, and
   a table of their counts (two rows per partition at most, hence broadcast)
   decides them.
4. The decisions meet per document and are returned as zlib-compressed
   bitmaps, one bit per line.

Keys: all of ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased.

Defined cases: null and empty texts are one empty line, which has no key and
is always kept; a key counts once per document however often it repeats there;
rows with the same doc_id and text are the same document (all of them are
treated alike, and count once); rows with the same doc_id and other texts are
documents of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, documents, keyed, materialise, partitions, row_key, text_slices

MIN_CHARS = 1
MIN_DOCS = 10
_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FLAGS = f"doc_id long, {ROW_KEY} long, n_lines int, at binary, h1 long, h2 long"


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACES).translate(_LOWER)


def _explode(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for start, texts in text_slices(batch, 1):
            docs, rows, at, n_lines, hashes = [], [], [], [], []
            for doc, row, text in zip(ids[start:], keys[start:], texts, strict=False):
                lines = (text or "").encode().split(b"\n")
                n = len(lines)
                for i, line in enumerate(lines):
                    key = line_key(line)
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        hashes.append(digest(key))
                        docs.append(doc)
                        rows.append(row)
                        at.append(i)
                        n_lines.append(n)
            two = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(n_lines, pa.int32())],
                names=["h1", "h2", "doc_id", ROW_KEY, "at", "n_lines"],
            )


class _Run:
    """The rows of one hash, as they stream by: per document, the positions."""

    def __init__(self, key: tuple[int, int], at_edge: bool) -> None:
        self.key, self.at_edge, self.docs = key, at_edge, []

    def add(self, doc, row: int, n_lines: int, at: np.ndarray) -> None:
        if self.docs and self.docs[-1][:2] == (doc, row):
            self.docs[-1][3].append(at)
        else:
            self.docs.append((doc, row, n_lines, [at]))


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by hash, document, position -> the lines to drop."""
    run: _Run | None = None
    names = ["doc_id", ROW_KEY, "n_lines", "at", "h1", "h2"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def close(r: _Run, last: bool) -> Iterator[tuple]:
        edge = r.at_edge or last
        if edge or len(r.docs) >= min_docs:
            for k, (doc, row, n, at) in enumerate(r.docs):
                places = np.unique(np.concatenate(at))
                if keep_first and k == 0 and not edge:
                    places = places[1:]
                if len(places):
                    yield doc, row, n, places.astype("<i4").tobytes(), *(r.key if edge else (None, None))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    out: list[tuple] = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        docs, rows = b.column(2).to_pylist(), b.column(3).to_numpy()
        at, n_lines = b.column(4).to_numpy(), b.column(5).to_numpy()
        known = np.fromiter((d is None for d in docs), bool, n)
        number = np.fromiter((d or 0 for d in docs), np.int64, n)
        new_hash = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_hash | np.r_[True, (number[1:] != number[:-1]) | (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])]
        starts = np.flatnonzero(new_doc)
        for s, e in zip(starts, np.r_[starts[1:], n], strict=True):
            key = (int(h1[s]), int(h2[s]))
            if run is None or run.key != key:
                if run is not None:
                    out.extend(close(run, last=False))
                run = _Run(key, at_edge=run is None)
            run.add(docs[s], int(rows[s]), int(n_lines[s]), at[s:e])
        if len(out) >= 20_000:
            yield batch(out)
            out = []
    if run is not None:
        out.extend(close(run, last=True))
    if out:
        yield batch(out)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dropped, maps = [], []
        for n, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for p in parts:
                keep[np.frombuffer(p, "<i4")] = False
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", ROW_KEY, "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, row key, n_lines, n_dropped, keep: one row for each document that loses a line.

    Keys of ``min_chars`` code points or more found in ``min_docs`` documents
    or more lose all their lines; with ``keep_first``, all but the first by
    (doc_id, position).
    """
    spark = docs.sparkSession
    n = partitions(spark)
    lines = keyed(docs).mapInArrow(lambda it: _explode(it, min_chars), f"h1 long, h2 long, doc_id long, {ROW_KEY} long, at int, n_lines int")
    ordered = lines.repartitionByRange(n, "h1", "h2", "doc_id", ROW_KEY).sortWithinPartitions("h1", "h2", "doc_id", ROW_KEY, "at")
    flags = materialise(ordered.mapInArrow(lambda it: _stream(it, min_docs, keep_first), _FLAGS), "line-flags")
    edge = flags.where("h1 is not null")
    # The first and last run of a partition only: bounded by the number of partitions.
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", ROW_KEY)).alias("_w_first")
    counts = edge.groupBy("h1", "h2").agg(F.count("*").alias("_w_docs"), first).where(F.col("_w_docs") >= min_docs)
    decided = edge.join(F.broadcast(counts), ["h1", "h2"])
    is_first = F.col("_w_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"_w_first.{ROW_KEY}") == F.col(ROW_KEY))
    at = F.when(is_first & F.lit(keep_first), F.expr("substring(at, 5)")).otherwise(F.col("at"))
    columns = ["doc_id", ROW_KEY, "n_lines", "at"]
    dropped = flags.where("h1 is null").select(*columns).unionByName(decided.withColumn("at", at).select(*columns)).where("octet_length(at) > 0")
    per_doc = dropped.groupBy("doc_id", ROW_KEY).agg(F.max("n_lines").alias("n_lines"), F.collect_list("at").alias("at"))
    return per_doc.mapInArrow(_bitmaps, f"doc_id long, {ROW_KEY} long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[bytes], int]:
    """The kept lines of a text, and how many lines it had."""
    lines = (text or "").encode().split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [x for x, k in zip(lines, bits, strict=True) if k], len(lines)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``_w_keep`` (null: all lines stay)."""
    own = docs.withColumn(ROW_KEY, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    right = bitmaps.select(F.col("doc_id").alias("_w_doc"), F.col(ROW_KEY).alias("_w_key"), F.col("keep").alias("_w_keep"))
    on = own["doc_id"].cast("long").eqNullSafe(right["_w_doc"]) & (own[ROW_KEY] == right["_w_key"])
    return own.join(right, on, "left").drop("_w_doc", "_w_key", ROW_KEY)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keeps = b.column(2)
        for start, texts in text_slices(b, 1):
            n, dropped, digests = [], [], []
            for i, text in enumerate(texts, start):
                lines, count = kept_lines(text, keeps[i].as_py())
                n.append(count)
                dropped.append(count - len(lines))
                digests.append(hashlib.sha256(b"\n".join(lines)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, keeps = b.schema.get_field_index("text"), b.column(b.num_columns - 1)
        for start, texts in text_slices(b, at):
            out = [None if t is None else b"\n".join(kept_lines(t, keeps[i].as_py())[0]).decode() for i, t in enumerate(texts, start)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else b.column(i).slice(start, len(texts)) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, the dropped lines gone from ``text``."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, **options))
    return joined.mapInArrow(_rewrite, docs.withColumn("text", F.col("text").cast("string")).schema)


def _mostly_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, bitmap -> doc_id and text of those that lose half of their non-blank lines or more."""
    for b in batches:
        most = []
        for start, texts in text_slices(b, 1):
            for i, text in enumerate(texts, start):
                lines, count = kept_lines(text, b.column(2)[i].as_py())
                most.append(count - len(lines) >= sum(1 for x in lines if line_key(x)))
        yield b.select([0, 1]).filter(pa.array(most, pa.bool_()))


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row key, n_lines and two bitmaps -> a line stays if one of them keeps it."""
    for b in batches:
        maps = []
        for one, two in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            bits = [np.frombuffer(zlib.decompress(x), np.uint8) for x in (one, two)] if two is not None else None
            maps.append(zlib.compress((bits[0] | bits[1]).tobytes()) if bits else one)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc_id", ROW_KEY, "keep"])


def drop_lines_but_copies(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``drop_lines``, but no group of copies loses its content.

    Documents that would lose half of their non-blank lines or more are taken
    for copies of each other: among them the first holder of each frequent line
    keeps it.  In all others frequent lines go, the first one too.
    """
    found = materialise(keep_bitmaps(docs, min_docs, min_chars), "line-bitmaps")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    losing = with_bitmaps(own, found).where("_w_keep is not null")
    copies = materialise(losing.mapInArrow(_mostly_frequent, "doc_id long, text string"), "line-copies")
    # Of a line that is not frequent the first bitmap keeps every occurrence.
    again = keep_bitmaps(copies, 1, min_chars, keep_first=True).select(F.col("doc_id").alias("_w_doc"), F.col(ROW_KEY).alias("_w_key"), F.col("keep").alias("_w_again"))
    # A copy without a bitmap in the second pass is the first holder of all its lines.
    whole = copies.select(F.col("doc_id").alias("_w_doc"), row_key().alias("_w_key")).distinct()
    again = whole.join(again, whole["_w_doc"].eqNullSafe(again["_w_doc"]) & (whole["_w_key"] == again["_w_key"]), "left").select(whole["_w_doc"], whole["_w_key"], "_w_again", F.lit(True).alias("_w_copy"))
    both = found.join(again, found["doc_id"].eqNullSafe(again["_w_doc"]) & (found[ROW_KEY] == again["_w_key"]), "left")
    both = both.where("_w_copy is null or _w_again is not null").select("doc_id", ROW_KEY, "n_lines", "keep", "_w_again")
    bitmaps = both.mapInArrow(_either, f"doc_id long, {ROW_KEY} long, keep binary")
    joined = with_bitmaps(docs, bitmaps)
    return joined.mapInArrow(_rewrite, docs.withColumn("text", F.col("text").cast("string")).schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_bitmaps(docs, keep_bitmaps(docs)).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP7_SQL = """
with t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from t),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
j as (select k.*, f.key is not null as dropped from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from j group by doc_id
"""
