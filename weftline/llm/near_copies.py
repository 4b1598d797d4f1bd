"""Near copies by SimHash, completed to exact Jaccard likeness of word shingles, for the pipeline's SimHash stage.

1. One pass makes the fingerprint (as ``simhash.fingerprint``) and the set of
   64-bit shingle hashes behind it; equal sets collapse to one node.
2. SimHash: ``simhash.link`` joins fingerprints within three bits by the counts
   of their segments (a spanning forest, never all pairs), nodes with one
   fingerprint are linked to the first of them.  The sets decide each link.
3. A radius is no bound for a likeness (pairs at Jaccard 0.8 differ in 4 to 14
   of 64 bits), so the links beyond it come by a rule that misses none: two sets
   with Jaccard 0.8 or more share one of their first ``n - ceil(0.8 n) + 1``
   hashes in ascending order (prefix filter).  These hashes are the cells; only
   pairs that SimHash has not put into one component are asked for.
4. Cells with the same members are one cell.  In a cell, sizes and a parity
   sketch leave pairs out.  Each hash flips one bit, so two sketches differ in
   no more bits than the sets have hashes apart: an exact bound as well.  A
   sketch has at least as many bits as the set has hashes (up to ``_WIDEST``),
   so that it also tells long texts apart.
5. Cells up to ``CELL`` members give all pairs left.  Larger ones (groups of
   near copies, common passages) give stars among members of different
   components, at most one pair a member, until a round links ``FEW`` pairs or
   less; then all pairs whose members are still in different components.
6. The sets decide every pair; they are made again for the nodes concerned only.

Cost: about a fifth of the shingles (hash and node) are exchanged once.  A cell with many
members in different components compares all their sketches in one task.

Defined cases: texts without words are equal to each other and to nothing
else; of a component the row with the smallest doc_id stays, then by text and
row hash, rows without id last; of equal rows one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import left_join_spread, materialise, partitions, text_slices
from .simhash import _BLOCK, _LOWER, SEED, components, link

CELL = 16
#: A round of stars that links no more pairs is the last one; what is left is asked for in full.
FEW = 1000
_FILTER = 1 << 22
_BITS = 1024
_WIDEST = 1 << 16


def hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    import xxhash

    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)], np.uint64)
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))), np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(hashes(text, words))


def print_of(hashes: np.ndarray) -> int:
    """``simhash.fingerprint`` of a text with these shingle hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def prefix(n: int) -> int:
    """How many hashes of a set of n are cells."""
    return n - -(-4 * n // 5) + 1 if n else 0


def bits_for(n: int) -> int:
    """Bits of the sketch of n hashes: a power of two, so that wider sketches fold to narrower ones."""
    return min(_WIDEST, max(_BITS, 1 << (n - 1).bit_length())) if n else _BITS


def sketch(hashes: np.ndarray) -> np.ndarray:
    bits = bits_for(len(hashes))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard 0.8 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _sets(words: int):
    """doc_id, text hash, row hash, text -> the same without text, fingerprint, set identity, size, sketch, cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for start, texts in text_slices(b, 3):
                prints, sets = [], []
                for t in texts:
                    every = hashes(t, words)
                    prints.append(print_of(every))
                    sets.append(np.unique(every))
                columns = [*(b.column(i).slice(start, len(texts)) for i in range(3)), pa.array(np.array(prints, np.uint64).view(np.int64))]
                columns += [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
                columns += [pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([s[: prefix(len(s))].view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "row_hash", "print", "same", "n", "sketch", "cells"])

    return run


class _Sketches:
    """The sketches of one cell's members, which are sorted by size."""

    def __init__(self, n: np.ndarray, marks: list[bytes]) -> None:
        self.n, self.words = n, np.fromiter((len(m) // 8 for m in marks), np.int64, len(marks))
        self.start = np.searchsorted(self.words, np.unique(self.words))
        ends = [*self.start[1:], len(marks)]
        self.held = {int(self.words[s]): np.frombuffer(b"".join(marks[s:e]), np.uint64).reshape(e - s, -1) for s, e in zip(self.start, ends, strict=True)}
        self.base = {int(self.words[s]): int(s) for s in self.start}

    def close(self, i: int, places: np.ndarray) -> np.ndarray:
        """Which of the later places may be alike to member i."""
        own = int(self.words[i])
        mark = self.held[own][i - self.base[own]]
        found = []
        for width in np.unique(self.words[places]).tolist():
            some = places[self.words[places] == width]
            for at in range(0, len(some), step := max(1, (1 << 19) // width)):
                part = some[at : at + step]
                marks = self.held[width][part - self.base[width]]
                while marks.shape[1] > own:
                    half = marks.shape[1] // 2
                    marks = marks[:, :half] ^ marks[:, half:]
                apart = np.bitwise_count(marks ^ mark).sum(1, dtype=np.int64)
                found.append(part[9 * apart <= self.n[i] + self.n[part]])
        return np.concatenate(found) if found else places[:0]


def _pairs(most: int | None, stars_only: bool = False):
    """Rows (cell, node, n, sketch, root), sorted by cell, size and node -> (cell, a, b): pairs to decide, with a > b.

    Of cells above ``most`` members stars only, and each member as (cell, node, null).
    """

    def of_cells(c: list, stop: int) -> Iterator[pa.RecordBatch]:
        cell, node, n, root = c[0][:stop], c[1][:stop], c[2][:stop].astype(np.int64), c[4][:stop]
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            a, b, keys = (np.concatenate(x) for x in zip(*out, strict=True))
            none = b < 0
            return pa.RecordBatch.from_arrays([pa.array(keys, mask=~none), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b), mask=none)], names=["cell", "a", "b"])

        for s, size in zip(new, np.diff(np.r_[new, stop]), strict=True):
            if size < 2:
                continue
            nodes, sizes, roots = node[s : s + size], n[s : s + size], root[s : s + size]
            large = most is not None and size > most
            if large and not stars_only:
                out.append((nodes, np.full(size, -1), cell[s : s + size]))
                held += size
            sketches = None
            left = np.arange(size)
            while len(left) > 1:
                i, left = left[0], left[1:]
                # Sorted by size: what is too large for this member ends the range.
                near = left[: np.searchsorted(4 * sizes[left], 5 * sizes[i], "right")]
                near = near[roots[near] != roots[i]]
                if not len(near):
                    continue
                sketches = sketches or _Sketches(sizes, c[3][s : s + size].tolist())
                found = sketches.close(int(i), near)
                if len(found):
                    out.append((np.full(len(found), nodes[i]), nodes[found], cell[s + found]))
                    held += len(found)
                if large or stars_only:
                    left = np.setdiff1d(left, found, assume_unique=True)
                if held >= 50_000:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            kept = new if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, new, strict=True)]
            stop = int(np.searchsorted(kept[0], kept[0][-1]))
            if stop:
                yield from of_cells(kept, stop)
                kept = [x[stop:] for x in kept]
        if kept is not None:
            yield from of_cells(kept, len(kept[0]))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node), sorted by both -> those whose cell has two rows or more, named by a hash of all its nodes.

    Cells with the same nodes so become one; a clash of two names would join two cells, and lose no pair.
    """
    import xxhash

    cell, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen: set[int] = set()

    def part(stop: int) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, cell[1:stop] != cell[: stop - 1]])
        sizes = np.diff(np.r_[new, stop])
        names, sent = [], []
        for s, size in zip(new[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            of = node[s : s + size]
            name = xxhash.xxh3_64_intdigest(of.tobytes())
            if name not in seen:
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(name)
                names.append(np.full(size, np.uint64(name)))
                sent.append(of)
        some = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, sent)]
        return pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), pa.array(some[1])], names=["cell", "node"])

    for b in batches:
        if b.num_rows:
            cell, node = np.r_[cell, b.column(0).to_numpy()], np.r_[node, b.column(1).to_numpy()]
            if stop := int(np.searchsorted(cell, cell[-1])):
                yield part(stop)
                cell, node = cell[stop:], node[stop:]
    if len(cell):
        yield part(len(cell))


def _candidates(members: DataFrame, most: int | None, stars_only: bool = False) -> DataFrame:
    """members: cell, node, n, sketch, root."""
    dealt = members.select("cell", "node", "n", "sketch", "root").repartition(partitions(members.sparkSession), "cell").sortWithinPartitions("cell", "n", "node")
    return materialise(dealt.mapInArrow(_pairs(most, stars_only), "cell long, a long, b long"), "near-pairs")


def _made(rows: DataFrame, concerned: DataFrame, words: int) -> DataFrame:
    """node and its set; rows: doc_id, row_hash, text, concerned: node, doc_id, row_hash.

    A bitmap of ``_FILTER`` bits leaves most other rows out before anything is exchanged.
    """
    bit = F.pmod("row_hash", F.lit(_FILTER)) + 1
    bits = concerned.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # _FILTER / 8 bytes at most
    held = {r["k"] - 1: bytes(r["bits"]) for r in bits}
    wanted = np.frombuffer(b"".join(held.get(k, bytes(4096)) for k in range(_FILTER // 32768)), np.uint8)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy() % _FILTER
            b = b.filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool)))
            for start, some in text_slices(b, 2):
                sets = pa.array([shingles(t, words).tobytes() for t in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(start, len(some)) for i in (0, 1)), sets], names=["doc_id", "row_hash", "made"])

    made = rows.select("doc_id", "row_hash", "text").mapInArrow(make, "doc_id long, row_hash long, made binary")
    home = concerned.toDF("node", "_w_d", "_w_r")
    on = made["doc_id"].eqNullSafe(home["_w_d"]) & (made["row_hash"] == home["_w_r"])
    return materialise(made.join(home, on).select("node", "made").dropDuplicates(["node"]), "near-made")


def _decided(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) that are alike."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column(2), b.column(3), strict=True)
            yes = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in both]
            yield b.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    concerned = materialise(nodes.join(named, "node").select("node", "first.doc_id", "first.row_hash"), "near-concerned")
    sets = _made(rows, concerned, words)
    both = pairs.join(sets.toDF("a", "_w_x"), "a").join(sets.toDF("b", "_w_y"), "b").select("a", "b", "_w_x", "_w_y")
    return materialise(both.mapInArrow(decide, "a long, b long"), "near-edges")


def _simhash_links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b: a forest of the fingerprints within three bits, and nodes with the fingerprint of a smaller one."""
    prints = materialise(nodes.groupBy("print").agg(F.min("node").alias("node"), F.count("*").alias("_w_n")), "near-prints")
    told = prints.where("_w_n > 1").select(F.col("print").alias("_w_k0"), "_w_n", F.col("node").alias("_w_least"))
    others = left_join_spread(nodes.select("print", "node"), told, [F.col("print")], nodes.count(), ["_w_least"]).where("node > _w_least")
    near = link(prints.select("print", "node"), prints.count())
    return near.unionByName(others.select(F.col("node").alias("a"), F.col("_w_least").alias("b")))


def _with_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).select(F.col("a").alias("_w_a"), F.col("b").alias("_w_b"))
    return nodes.join(found, nodes["node"] == found["_w_a"], "left").withColumn("root", F.coalesce("_w_b", "node")).drop("_w_a", "_w_b")


def keep_one_alike(docs: DataFrame, words: int, cell: int = CELL) -> DataFrame:
    """``docs`` with its columns, one row of each component of texts with Jaccard 0.8 or more."""
    text = F.col("text").cast("string")
    named = docs.withColumns({"_w_id": F.col("doc_id").cast("long"), "_w_text": F.xxhash64(text), "_w_all": F.xxhash64(*docs.columns)})
    rows = named.select(F.col("_w_id").alias("doc_id"), F.col("_w_text").alias("text_hash"), F.col("_w_all").alias("row_hash"), text.alias("text"))
    schema = "doc_id long, text_hash long, row_hash long, print long, same binary, n int, sketch binary, cells array<long>"
    sets = rows.mapInArrow(_sets(words), schema)
    # Equal sets have equal sizes, sketches and cells.
    firsts = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_hash", "print")).alias("first")
    nodes = sets.groupBy("same").agg(firsts, *[F.first(c).alias(c) for c in ("n", "sketch", "cells")]).drop("same")
    nodes = materialise(nodes.withColumns({"node": F.monotonically_increasing_id(), "print": F.col("first.print")}), "near-nodes")
    narrow = nodes.drop("cells", "print")
    asked = materialise(_simhash_links(nodes.select("print", "node")), "near-asked")
    edges = _decided(rows, narrow, asked, words)
    exploded = nodes.select(F.explode("cells").alias("cell"), "node").repartition(partitions(docs.sparkSession), "cell").sortWithinPartitions("cell", "node")
    shared = exploded.mapInArrow(_shared, "cell long, node long").distinct()

    def more(found: DataFrame) -> DataFrame:
        """The pairs that were not asked for before."""
        new = found.where("b is not null").select("a", "b").distinct()
        return materialise(new.join(asked, ["a", "b"], "left_anti"), "near-asked")

    found = _candidates(shared.join(_with_roots(narrow, edges), "node"), cell)
    large = found.where("b is null").select("cell", F.col("a").alias("node"))
    new = more(found)
    stars = True
    while True:
        asked = asked.unionByName(new)
        linked = _decided(rows, narrow, new, words)
        edges = edges.unionByName(linked)
        if not stars or large.isEmpty():
            break
        stars = linked.count() > FEW
        new = more(_candidates(large.join(_with_roots(narrow, edges), "node"), None, stars))
    kept = _with_roots(narrow, edges).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_w_d"), F.col("first.row_hash").alias("_w_r"))
    stay = named["_w_id"].eqNullSafe(kept["_w_d"]) & (named["_w_all"] == kept["_w_r"])
    return named.join(kept, stay, "left_semi").dropDuplicates(["_w_id", "_w_all"]).select(*docs.columns)
