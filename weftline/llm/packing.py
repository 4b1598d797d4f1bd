"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each partition encodes its texts, cuts over-long documents and packs the
   pieces best-fit decreasing, ``WINDOW`` pieces at a time.  Ids never leave
   the task; what comes out is one narrow row per piece.
2. Bins with fewer than ``SLACK`` free places are sealed.  The others are items
   of the next round: groups of ``FAN_IN`` partitions pack their underfull bins
   best-fit, seal, and so on up the tree to one group.
3. The rounds' moves (bin -> parent bin, offset) are composed and joined to the
   pieces once.  They concern underfull bins only.

Memory is bounded without a cap on bins: after best-fit, no two open bins of a
group fit together, so at most one of them is half full or less, and any later
merge takes one of those.  In the groups of a round there are thus no more such
bins than groups, and of open bins with one and the same fill no more than that
can ever be merged; further ones are sealed, which changes no later merge.  A
group hands on at most (number of groups) x (capacity / 2) bins.

Defined cases: a null or empty text is the separator alone; strings of special
tokens are ids of these tokens, as the tokenizer file says; rows with the same
doc_id are packed as documents of their own; equal lengths are placed in input
order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkMemo
from .common import documents, materialise, text_columns

CAPACITY = 2048
SEPARATOR = 0
SLACK = 8
FAN_IN = 8
WINDOW = 200_000
TOKENIZER = "byte_bpe_50k.json"
_PLACE = 33


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and the bins' fills.

    Open bins hang in a list for each number of free places; the bits of one
    integer tell which lists hold any, so the tightest fit is one bit search.
    """
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = held >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                held ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            if not free[room - size]:
                held ^= 1 << (room - size)
            free[room - size].append(b)
    return bins, offsets, np.asarray(fills, np.int64)


#: Chunks that are encoded in one call, as segments between special tokens.
_AT_ONCE = 1000


@lru_cache(maxsize=2)
def _memo(path: str, limit: int = 400_000) -> ChunkMemo:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    # A special token that takes no characters beside it keeps its neighbours apart, so that one call encodes many chunks.
    plain = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
    if len(added) != 1 or not plain:
        return ChunkMemo(lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], limit=0)
    wall, string = plain[0]

    def encode_many(texts: list[str]) -> list[bytes]:
        if len(texts) == 1:
            return [np.array(tokenizer.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()]
        out: list[bytes] = []
        for at in range(0, len(texts), _AT_ONCE):
            some = texts[at : at + _AT_ONCE]
            ids = np.array(tokenizer.encode_batch_fast([string.join(some)], add_special_tokens=False)[0].ids, "<u4")
            walls = np.flatnonzero(ids == wall).tolist()
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(w + 1 for w in walls)], [*walls, len(ids)], strict=True)]
        return out

    return ChunkMemo(encode_many, limit, string)


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def _pieces(path: str | None, capacity: int, separator: int, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            memo = _memo(public_tokenizers.path(TOKENIZER), memory)
        else:
            memo = _memo(path, memory)
        end = np.asarray([separator], "<u4").tobytes()
        base = TaskContext.get().partitionId() << _PLACE
        docs: list[int | None] = []
        rows: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            columns = np.asarray(rows, np.int64).T
            bins, offsets, fills = best_fit(columns[2], capacity)
            out = [pa.array(docs, pa.int64()), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:]), pa.array(bins + base), pa.array(offsets), pa.array(fills[bins])]
            base += len(fills)
            docs.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _PIECES.split(", ")])

        crc = zlib.crc32
        for b in batches:
            names = b.column(0)
            for at, texts in text_columns(b, 1):
                ids, ends = memo.ids(texts)
                raw, begin = memoryview(ids.tobytes()), 0
                for doc, stop in zip(names.slice(at, len(texts)).to_pylist(), ends.tolist(), strict=True):
                    for k, (start, length) in enumerate(_cut(stop - begin + 1, capacity)):
                        last = min(begin + start + length, stop)
                        found = crc(raw[4 * (begin + start) : 4 * last])
                        docs.append(doc)
                        rows.append((k, start, length, found if last - begin - start == length else crc(end, found)))
                    begin = stop
                while len(rows) >= WINDOW:
                    yield flush()
        if rows:
            yield flush()

    return run


def _merge(capacity: int, sealed_from: int, groups: int):
    """A group of the round's ``groups``: bin -> parent bin, offset there, and the parent's fill (``capacity`` if sealed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("bin")
        own, sizes = table["bin"].to_numpy(), table["fill"].to_numpy()
        bins, offsets, fills = best_fit(sizes, capacity)
        still = fills.copy()
        by_fill = np.argsort(fills, kind="stable")
        run_ = fills[by_fill]
        nth = np.arange(len(run_)) - np.searchsorted(run_, run_)
        still[by_fill[(nth >= groups) | (run_ >= sealed_from)]] = capacity
        first = np.zeros(len(fills), np.int64)
        first[bins[offsets == 0]] = own[offsets == 0]  # a bin is named after its first member: unique without a counter
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(first[bins]), pa.array(offsets), pa.array(still[bins])], names=["bin", "parent", "moved", "fill"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, tokenizer: str | None = None, slack: int = SLACK, fan_in: int = FAN_IN, memory: int = 400_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.  memory: words whose ids a worker remembers, twice."""
    if capacity < 1 or fan_in < 2:
        raise ValueError("capacity must be at least 1, fan_in at least 2")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    pieces = materialise(texts.mapInArrow(_pieces(tokenizer, capacity, separator, memory), _PIECES), "pack-pieces")
    sealed_from = capacity - slack
    open_bins = pieces.where((F.col("place") == 0) & (F.col("fill") < sealed_from)).select("bin", "fill", F.shiftright("bin", _PLACE).alias("part"))
    parts = (open_bins.agg(F.max("part")).first()[0] or 0) + 1
    moves: DataFrame | None = None
    while True:
        parts = -(-parts // fan_in)
        grouped = open_bins.withColumn("part", F.expr(f"part div {fan_in}"))
        step = grouped.repartition(parts, "part").select("bin", "fill").mapInArrow(_merge(capacity, sealed_from, parts), "bin long, parent long, moved long, fill long")
        step = materialise(step, "pack-moves")
        part = grouped.select(F.col("bin").alias("_w_bin"), "part")
        if moves is None:
            moves = step.select("bin", "parent", "moved")
        else:
            later = step.select(F.col("bin").alias("_w_from"), F.col("parent").alias("_w_to"), F.col("moved").alias("_w_by"))
            moves = moves.join(later, moves["parent"] == later["_w_from"], "left").select("bin", F.coalesce("_w_to", "parent").alias("parent"), (F.col("moved") + F.coalesce("_w_by", F.lit(0))).alias("moved"))
        if parts <= 1:
            break
        open_bins = materialise(step.where((F.col("moved") == 0) & (F.col("bin") == F.col("parent")) & (F.col("fill") < sealed_from)).join(part, F.col("bin") == F.col("_w_bin")).select("bin", "fill", "part"), "pack-open")
    moves = moves.select(F.col("bin").alias("_w_bin"), "parent", "moved")
    return pieces.join(moves, pieces["bin"] == moves["_w_bin"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("moved", F.lit(0))).alias("offset"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
