"""SimHash near-dedup by segment-popcount embedding.

1. One pass makes the 64-bit fingerprints; equal ones collapse to one node, so groups of copies cost nothing afterwards.
2. A fingerprint is mapped to the bit counts of its 32 two-bit segments.  The
   Manhattan distance of two such vectors is at most the Hamming distance of
   the fingerprints.  Cut into ``m`` bands, a pair within distance 3 has equal
   counts in at least ``m - 3`` bands: each choice of that many bands is a grid
   whose cells are joined by equality.  Inside a cell the total bit counts
   bound the distance (a range of a sorted array), then the Manhattan distance
   of the count vectors does, and the exact distance of the fingerprints that
   are left decides.
3. A cell emits a spanning forest of its links, at most one edge less than it
   has members, never all pairs.  A cell with more than ``CELL`` members is
   dealt into blocks, each pair of blocks to a task of its own.
4. Components come from alternating large-star and small-star rounds on the
   edges, each round written to the shared folder.

Grids get finer as the fingerprints get more (``bands_for``), so the expected
number of chance meetings in a cell stays small.

Nodes are fingerprints; rows with the same doc_id link theirs, so a doc_id is in
one component.  Fingerprints, doc_ids and components that many rows share (a
group of copies) are told to these rows by broadcast (``left_join_spread``).

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; rows with the same doc_id are in one component, whatever their
texts; rows without doc_id are linked by their fingerprints alone, and a
component whose doc_ids are all null has a null id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, left_join_spread, materialise, partitions, text_slices

WORDS = 3
DISTANCE = 3
SEED = 42
CELL = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    import xxhash

    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        some = parts[at : at + _BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(words)), strict=False)) if len(some) >= words else [b" ".join(some)]
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, 1):
                prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(prints)], names=["doc_id", "print"])

    return run


def bands_for(n: int) -> int:
    """Bands of the grid: from 5 (10 grids) up, as fingerprints grow 64-fold."""
    bands, held = 5, 1 << 20
    while n > held and bands < 10:
        bands, held = bands + 1, held << 6
    return bands


def _masks(bands: int, distance: int) -> list[int]:
    """Bit masks of the chosen bands' segments, each segment two bits wide."""
    edges = [round(32 * k / bands) for k in range(bands + 1)]
    of = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(of, bands - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


_ODD = np.uint64(0x5555555555555555)


def embedded(prints: np.ndarray) -> np.ndarray:
    """The counts of the 32 two-bit segments in unary, so that differing bits are the Manhattan distance of the count vectors."""
    half = prints >> np.uint64(1)
    return ((prints | half) & _ODD) | ((prints & half & _ODD) << np.uint64(1))


def within(prints: np.ndarray, counts: np.ndarray, i: int, places: np.ndarray, distance: int) -> np.ndarray:
    """The places whose fingerprint is within ``distance`` of place i: those that the Manhattan distance does not rule out, verified."""
    places = places[np.bitwise_count(counts[places] ^ counts[i]) <= distance]
    return places[np.bitwise_count(prints[places] ^ prints[i]) <= distance]


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (as places) of a spanning forest of the links among fingerprints.

    Each found member leaves the array of those not reached yet, so a dense
    cluster takes one pass over it for each of its members that reaches others.
    """
    counts = embedded(prints)
    weight = np.bitwise_count(prints).astype(np.int16)
    order = np.argsort(weight, kind="stable")
    left, left_weight = order, weight[order]
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier = [int(left[0])]
        left, left_weight = left[1:], left_weight[1:]
        while frontier and len(left):
            x = frontier.pop()
            lo, hi = np.searchsorted(left_weight, [weight[x] - distance, weight[x] + distance + 1])
            near = within(prints, counts, x, left[lo:hi], distance)
            if len(near):
                found = near.tolist()
                edges += [(x, y) for y in found]
                frontier += found
                stay = np.ones(len(left), bool)
                stay[lo:hi] = np.isin(left[lo:hi], near, assume_unique=True, invert=True)
                left, left_weight = left[stay], left_weight[stay]
    return edges


def _link_cells(distance: int):
    """Rows (cell, print, node), sorted by cell -> edges (a, b), a > b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(4))

        def edges_of(c: tuple[np.ndarray, ...], stop: int) -> tuple[np.ndarray, np.ndarray]:
            cell, block, prints, node = (x[:stop] for x in c)
            prints = prints.view(np.uint64)
            new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])])
            size = np.diff(np.r_[new, stop])
            two = new[size == 2]
            counts = embedded(prints)
            near = two[np.bitwise_count(counts[two] ^ counts[two + 1]) <= distance]
            hit = near[np.bitwise_count(prints[near] ^ prints[near + 1]) <= distance]
            left, right = [node[hit]], [node[hit + 1]]
            for s, n in zip(new[size > 2], size[size > 2], strict=True):
                if found := forest(prints[s : s + n], distance):
                    pairs = np.asarray(found)
                    left.append(node[s + pairs[:, 0]])
                    right.append(node[s + pairs[:, 1]])
            a, b = np.concatenate(left), np.concatenate(right)
            return np.maximum(a, b), np.minimum(a, b)

        def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            kept = tuple(np.r_[old, b.column(i).to_numpy()] for i, old in enumerate(kept))
            last = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
            stop = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if stop:
                yield batch(*edges_of(kept, stop))
                kept = tuple(x[stop:] for x in kept)
        if len(kept[0]):
            yield batch(*edges_of(kept, len(kept[0])))

    return run


def link(nodes: DataFrame, n_nodes: int, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect all nodes within ``distance``; nodes: print, node, one row per fingerprint."""
    spark = nodes.sparkSession
    half = F.shiftrightunsigned("print", 1)
    every_other = F.lit(0x5555555555555555)
    two = F.col("print").bitwiseAND(half).bitwiseAND(every_other)
    one = F.col("print").bitwiseXOR(half).bitwiseAND(every_other)
    counts = F.shiftleft(two, 1).bitwiseOR(one)
    cells = F.array(*[F.xxhash64(F.lit(k), F.col("_w_counts").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(_masks(bands_for(n_nodes), distance))])
    members = nodes.withColumn("_w_counts", counts).select(F.explode(cells).alias("cell"), "print", "node")
    # Cells above the limit: at most (rows / limit) of them, and only those are dealt into pairs of blocks.
    crowded = members.groupBy("cell").count().where(F.col("count") > cell).select(F.col("cell").alias("_w_cell"), F.expr(f"cast(ceil(count / {cell}) as int)").alias("_w_blocks"))
    crowded = materialise(crowded, "simhash-crowded")
    own = F.expr("cast(pmod(xxhash64(print), _w_blocks) as int)")
    pairs = F.expr("transform(sequence(0, _w_blocks - 1), j -> cast(least(j, _w_own) as bigint) * 2147483648 + greatest(j, _w_own))")
    dealt = members.join(crowded, F.col("cell") == F.col("_w_cell"), "left").withColumn("_w_own", own)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("_w_blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
    n = partitions(spark)
    sorted_ = dealt.select("cell", "block", "print", "node").repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "print")
    return sorted_.mapInArrow(_link_cells(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: each node with edges but the smallest of its component, and that smallest.

    edges: a > b.  Alternates large-star and small-star (Kiveris et al. 2014)
    until nothing changes; each round at least halves the longest path, so twice
    the bits of the number of edges are more rounds than any graph needs.  Hubs
    hear of their smallest neighbour by broadcast.
    """
    held = materialise(edges, "edges")
    state, n = None, held.count()
    for _ in range(2 * max(1, n).bit_length() + 4):
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(F.col("u").alias("_w_k0")).agg(F.min("v").alias("m"), F.count("*").alias("_w_n"))
        told = left_join_spread(both.where("v > u"), least, [F.col("u")], 2 * n, ["m"])
        large = told.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("_w_k0")).agg(F.min("b").alias("m"), F.count("*").alias("_w_n"))
        joined = left_join_spread(large, least, [F.col("a")], n, ["m"])
        small = joined.select(F.col("a"), F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        held = materialise(small, "edges")
        now = held.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))"), F.sum(F.col("b").cast("decimal(38, 0)"))).first()
        if now == state:
            return held
        state, n = now, now["n"]
    raise RuntimeError("components did not settle")


def _links_of_ids(prints: DataFrame, n: int) -> DataFrame | None:
    """Edges (a, b) that join the fingerprints of rows with the same doc_id; None if no doc_id has two."""
    several = prints.where("doc_id is not null").groupBy(F.col("doc_id").alias("_w_k0")).agg(F.min("print").alias("_w_least"), F.max("print").alias("_w_most"), F.count("*").alias("_w_n")).where("_w_least < _w_most")
    several = materialise(several, "simhash-ids")
    if several.isEmpty():
        return None
    told = left_join_spread(prints.where("doc_id is not null"), several, [F.col("doc_id")], n, ["_w_least"])
    return told.where("print > _w_least").select(F.col("print").alias("a"), F.col("_w_least").alias("b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, print (signed long), component_id: one row per row of ``docs``."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    prints = materialise(texts.mapInArrow(_fingerprints(words), "doc_id long, print long"), "simhash-prints")
    n = prints.count()
    nodes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("_w_n")), "simhash-nodes")
    edges = link(nodes.select("print", F.col("print").alias("node")), nodes.count(), distance)
    if (of_ids := _links_of_ids(prints, n)) is not None:
        edges = edges.unionByName(of_ids).distinct()
    roots = components(edges)
    members = roots.unionByName(roots.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("_w_a"), F.col("b").alias("root"))
    members = nodes.join(members, F.col("print") == F.col("_w_a")).select("print", "least", "root")
    of_root = members.groupBy(F.col("root").alias("_w_k0")).agg(F.min("least").alias("component_id"), F.count("*").alias("_w_n"))
    linked = left_join_spread(members, of_root, [F.col("root")], n, ["component_id"]).select(F.col("print").alias("_w_p"), F.col("component_id").alias("_w_c"))
    labels = nodes.join(linked, F.col("print") == F.col("_w_p"), "left").select(F.col("print").alias("_w_k0"), "_w_n", F.coalesce("_w_c", "least").alias("component_id"))
    return left_join_spread(prints, labels, [F.col("print")], n, ["component_id"]).select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with its columns, of each component the document with the smallest id only; rows without id stay."""
    found = near_duplicates(docs, words, distance)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_w_kept")).distinct()
    named = docs.where("doc_id is not null")
    # After the join the rows lie by doc_id: dropping repeated ones takes no exchange.
    one = named.join(kept, named["doc_id"].cast("long") == kept["_w_kept"]).dropDuplicates(["_w_kept"]).drop("_w_kept")
    return one.unionByName(docs.where("doc_id is null"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
