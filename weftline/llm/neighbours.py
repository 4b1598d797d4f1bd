"""Approximate nearest neighbours by collision counting.

Rows are dealt into blocks of about equal size that are compact in space; the
index of a block is, for each of ``PROJECTIONS`` directions (orthonormal bases),
the sorted array of the block's projections.  A query opens a window around its
own place in every array and widens all of them step by step (virtual
rehashing).  A vector that has been in ``COLLISIONS`` of the windows is verified
by its exact cosine.

* *Counting.*  Windows begin and end at ``GROUPS`` cuts of the array, and for
  each cut the block holds a bitmap of the rows before it: a window is the
  exclusive or of two bitmaps, and the windows of a query are counted by adders
  on bit planes, 64 rows to a word.
* *End of a search.*  With unit directions, a vector at distance d lies within
  d of the query in every array.  A block is done when the k-th distance known
  is less than what all windows cover, or when ``k`` plus the share
  ``verified`` of its vectors have been verified.  ``verified=None`` leaves the
  second rule out: nothing that is nearer can be missed then.
* *Blocks.*  A cell is a sign vector: on which side of the median a row lies in
  the first few directions (as many as the rows need).  Cells that are too
  large (copies) are dealt by hash into several blocks.  Blocks are assigned to
  tasks by size.
* *Who goes where.*  A query first searches the block where it would lie; that
  bounds its k-th distance.  Then it goes on to the blocks whose cell can hold
  something nearer, and to no others: the squared gaps between the query and
  the cell may add up to ``reach`` x (split directions / dimensions) of the
  squared bound, which is what a neighbour at that distance has in these
  directions on average.  ``reach=None`` takes the squared bound itself, which
  leaves nothing out.

So ``nearest(..., verified=None, reach=None)`` is exact.  On data without any
structure (directions at random) most cells stay open whatever the method; on
clustered data few do.  Every row is indexed; the medians come from sketches of
all rows.  Driver and workers hold a few numbers for each cell: at most
2**``MOST_SPLITS`` cells for each of ``FREQUENT`` vector lengths, and one for
each other length.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows without id; vectors of another length than
the query's are no candidates; rows that share the query's vec_id are its own;
rows with the same vec_id are one candidate, and one query, with the best of
their scores; ties go to the smaller vec_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, prepare

K = 5
QUERY_EVERY = 50
#: Rows of a block: as many as give each task two blocks, between these.
LEAST_BLOCK, MOST_BLOCK = 2048, 16_384
PROJECTIONS = 128
COLLISIONS = 0.57
VERIFIED = 0.15
REACH = 1.5
#: Cuts of a sorted array, the first half width of a window in them, and by how many it grows.
GROUPS, START, STEP = 64, 12, 2
QUERIES_AT_ONCE = 256
MOST_SPLITS, FREQUENT = 12, 16
SEED = 11
_PAIRS = 32_768


@lru_cache(maxsize=64)
def directions(size: int, count: int = PROJECTIONS) -> np.ndarray:
    """(size, count): unit directions, orthonormal basis after basis."""
    draw = np.random.default_rng([SEED, size])
    bases = [np.linalg.qr(draw.standard_normal((size, min(size, count))))[0] for _ in range(-(-count // size))]
    return np.ascontiguousarray(np.concatenate(bases, axis=1)[:, :count])


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(1))
    return vectors / norms[:, None], norms


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def at_least(bits: Iterable[np.ndarray], needed: int) -> np.ndarray:
    """Where ``needed`` or more of the bitmaps are set."""
    levels: list[list[np.ndarray]] = [[]]
    for x in bits:
        levels[0].append(x)
        k = 0
        while len(levels[k]) == 3:
            if k + 1 == len(levels):
                levels.append([])
            total, carry = _add(*levels[k])
            levels[k] = [total]
            levels[k + 1].append(carry)
            k += 1
    planes: list[np.ndarray] = []
    k = 0
    while k < len(levels):
        if len(levels[k]) == 2:
            if k + 1 == len(levels):
                levels.append([])
            a, b = levels[k]
            levels[k + 1].append(a & b)
            levels[k] = [a ^ b]
        elif len(levels[k]) == 3:
            if k + 1 == len(levels):
                levels.append([])
            total, carry = _add(*levels[k])
            levels[k] = [total]
            levels[k + 1].append(carry)
        planes.append(levels[k][0])
        k += 1
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], np.iinfo(np.uint64).max)
    if needed >> len(planes):
        return more
    for k in range(len(planes) - 1, -1, -1):
        if needed >> k & 1:
            same = same & planes[k]
        else:
            more = more | (same & planes[k])
            same = same & ~planes[k]
    return more | same


class Block:
    """The sorted projections of a block of vectors, as bitmaps of the rows before each cut."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, collisions: float = COLLISIONS) -> None:
        self.ids, self.vectors, n = ids, vectors, len(ids)
        self.directions = directions(vectors.shape[1], projections)
        self.needed = max(1, int(np.ceil(collisions * projections)))
        unit, self.norms = _unit(vectors)
        self.groups = max(1, min(GROUPS, n))
        self.cut = np.arange(self.groups + 1) * n // self.groups
        words = -(-n // 64)
        self.before = np.zeros((projections, self.groups + 1, words), np.uint64)
        self.sorted = np.empty((projections, n))
        #: The nearest values that a window from or to a cut leaves out.
        self.below, self.above = np.full((projections, self.groups + 1), -np.inf), np.full((projections, self.groups + 1), np.inf)
        as_bytes = self.before.view(np.uint8).reshape(projections, self.groups + 1, -1)
        group, rank = np.repeat(np.arange(self.groups), np.diff(self.cut)), np.empty(n, np.int64)
        for j in range(projections):
            values = unit @ self.directions[:, j]
            order = np.argsort(values, kind="stable")
            self.sorted[j] = values[order]
            rank[order] = group
            as_bytes[j, :, : -(-n // 8)] = np.packbits(rank < np.arange(self.groups + 1)[:, None], axis=1, bitorder="little")
            self.below[j, 1:] = self.sorted[j][self.cut[1:] - 1]
            self.above[j, :-1] = self.sorted[j][self.cut[:-1]]

    def cosines(self, rows: np.ndarray, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Pair by pair in double precision, so equal vectors get equal scores."""
        return (self.vectors[rows] * queries).sum(1) / (self.norms[rows] * norms)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int = K, verified: float | None = VERIFIED) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vec_ids, scores) of the best found for each query; bounds: a score that is known to be reached by k others, or -inf."""
        n, m = len(self.ids), len(self.sorted)
        enough = n + 1 if verified is None else k + 1 + int(verified * n)
        unit, norms = _unit(queries)
        centres = unit @ self.directions
        place = np.stack([s.searchsorted(centres[:, j]) for j, s in enumerate(self.sorted)], axis=1)
        home = np.minimum(np.searchsorted(self.cut, place, "right") - 1, self.groups - 1)
        seen = np.zeros((len(queries), self.before.shape[2]), np.uint64)
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        count = np.zeros(len(queries), np.int64)
        active, half = np.arange(len(queries)), START
        each = np.arange(m)
        while len(active):
            lo, hi = np.maximum(home[active] - half, 0), np.minimum(home[active] + 1 + half, self.groups)
            full = ((lo == 0) & (hi == self.groups)).all(1)
            cover = np.minimum(centres[active] - self.below[each, lo], self.above[each, hi] - centres[active]).min(1)
            hit = at_least((self.before[j][hi[:, j]] ^ self.before[j][lo[:, j]] for j in range(m)), self.needed)
            fresh = hit & ~seen[active]
            seen[active] |= hit
            which, rows = np.nonzero(np.unpackbits(fresh.view(np.uint8), axis=1, count=n, bitorder="little"))
            scores = np.concatenate([self.cosines(rows[s : s + _PAIRS], queries[active[which[s : s + _PAIRS]]], norms[active[which[s : s + _PAIRS]]]) for s in range(0, len(rows), _PAIRS)] or [np.zeros(0)])
            edges = np.searchsorted(which, np.arange(len(active) + 1))
            going = []
            for i, q in enumerate(active.tolist()):
                a, b = edges[i], edges[i + 1]
                if a < b:
                    count[q] += b - a
                    best[q] = best_of(np.r_[best[q][0], self.ids[rows[a:b]]], np.r_[best[q][1], scores[a:b]], k, query_ids[q])
                kth = max(bounds[q], best[q][1][k - 1] if len(best[q][1]) >= k else -np.inf)
                if full[i] or kth > -np.inf and (count[q] >= enough or np.sqrt(max(0.0, 2 - 2 * kth)) + 1e-9 < cover[i]):
                    continue
                going.append(q)
            active, half = np.asarray(going, np.int64), half + STEP
        return best


def best_of(ids: np.ndarray, scores: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (score, smaller id), each id once, without the query's own."""
    if len(ids) > 64 * k:
        some = scores >= np.partition(scores, len(ids) - 32 * k)[len(ids) - 32 * k]
        found = best_of(ids[some], scores[some], k, own)
        if len(found[0]) == k:
            return found
    by = np.lexsort((ids, -scores))
    ids, scores = ids[by], scores[by]
    first = np.zeros(len(ids), bool)
    first[np.unique(ids, return_index=True)[1]] = True
    first &= ids != own
    return ids[first][:k], scores[first][:k]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def _search(k: int, verified: float | None):
    """Rows (block, query, vec_id, v, bound), sorted so that a block's own rows come before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        key = None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def answer(names: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            if block is None:
                block = Block(np.concatenate(ids), np.concatenate(rows))
                ids.clear()
                rows.clear()
            found = block.search(names, queries, bounds, k, verified)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

        for b in batches:
            blocks, is_query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            names, bounds = b.column(2).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (is_query[1:] != is_query[:-1]), True]) if b.num_rows else [0]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if blocks[s] != key:
                    key, block = blocks[s], None
                    ids.clear()
                    rows.clear()
                if not is_query[s]:
                    ids.append(names[s:e].copy())
                    rows.append(_matrix(b.column(3).slice(s, e - s), len(b.column(3)[int(s)])).copy())
                elif block is not None or ids:
                    for at in range(int(s), int(e), QUERIES_AT_ONCE):
                        stop = min(at + QUERIES_AT_ONCE, int(e))
                        yield answer(names[at:stop], _matrix(b.column(3).slice(at, stop - at), len(b.column(3)[at])), bounds[at:stop])

    return run


class Cells:
    """Where cells and blocks are: for each vector length the cuts, the cells' sign vectors, and the blocks of each cell."""

    def __init__(self, cuts: dict[int, np.ndarray], counts: dict[tuple[int, int], int], block: int, tasks: int) -> None:
        self.cuts = cuts
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes: list[float] = []
        for size in sorted({s for s, _ in counts}):
            cells = sorted(c for s, c in counts if s == size)
            blocks = [-(-counts[size, c] // block) for c in cells]
            first = len(sizes) + np.cumsum([0, *blocks[:-1]])
            for c, k in zip(cells, blocks, strict=True):
                sizes += [counts[size, c] / k] * k
            self.of[size] = np.asarray(cells, np.int64), np.asarray(first, np.int64), np.asarray(blocks, np.int64)
        self.blocks = len(sizes)
        # The largest block first, each to the task that has least.
        self.tasks = max(1, min(tasks, len(sizes)))
        self.task = np.zeros(len(sizes), np.int32)
        load = [(0.0, t) for t in range(self.tasks)]
        for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            held, t = heapq.heappop(load)
            self.task[at] = t
            heapq.heappush(load, (held + sizes[at], t))

    def project(self, vectors: np.ndarray) -> np.ndarray:
        size = vectors.shape[1]
        splits = len(self.cuts.get(size, ()))
        return _unit(vectors)[0] @ directions(size)[:, :splits]

    def cell(self, projected: np.ndarray, size: int) -> np.ndarray:
        cuts = self.cuts.get(size, np.zeros(0))
        return ((projected > cuts) << np.arange(len(cuts))).sum(1).astype(np.int64)

    def home(self, vectors: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The block of each vector; -1 if its cell has no rows."""
        size = vectors.shape[1]
        if size not in self.of:
            return np.full(len(vectors), -1)
        cells, first, blocks = self.of[size]
        own = self.cell(self.project(vectors), size)
        at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
        return np.where(cells[at] == own, first[at] + (salt % blocks[at].astype(np.uint64)).astype(np.int64), -1)

    def open(self, vectors: np.ndarray, bounds: np.ndarray, reach: float | None) -> list[np.ndarray]:
        """For each query the blocks that can hold something nearer than its bound."""
        size = vectors.shape[1]
        if size not in self.of:
            return [np.zeros(0, np.int64)] * len(vectors)
        cells, first, blocks = self.of[size]
        cuts = self.cuts.get(size, np.zeros(0))
        x = self.project(vectors)
        side = x > cuts
        gaps = (x - cuts) ** 2
        bits = (cells[:, None] >> np.arange(len(cuts)) & 1).astype(np.float64)
        # The gap counts where the cell's side is the other one.
        apart = (gaps * side).sum(1)[:, None] + (gaps * (1 - 2 * side)) @ bits.T
        part = 1.0 if reach is None else min(1.0, reach * len(cuts) / size)
        near = apart <= (np.maximum(0.0, 2 - 2 * bounds) * part + 1e-9)[:, None]
        return [np.concatenate([np.arange(f, f + k) for f, k in zip(first[row], blocks[row], strict=True)] or [np.zeros(0, np.int64)]) for row in near]


def _by_size(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length in a batch."""
    sizes = b.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        yield places, _matrix(b.column(at).take(pa.array(places)), size)


def _salt(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)


_DEALT = "task int, block long, query boolean, vec_id long, v array<double>, bound double"


def _dealt(b: pa.RecordBatch, rows: np.ndarray, block: np.ndarray, cells: Cells, query: bool, bound: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(cells.task[block]), pa.array(block), pa.array(np.full(n, query)), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(bound)], names=["task", "block", "query", "vec_id", "v", "bound"])


def _deal_home(cells: Cells, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, vectors in _by_size(b, 1):
                block = cells.home(vectors, _salt(b.column(0).to_numpy()[places]))
                held = block >= 0
                yield _dealt(b, places[held], block[held], cells, query, np.full(int(held.sum()), -np.inf))

    return run


def _deal_on(cells: Cells, reach: float | None):
    """(vec_id, v, bound) -> a copy for each block to visit, but the one at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                bounds = b.column(2).to_numpy(zero_copy_only=False)
                for places, vectors in _by_size(b, 1):
                    home = cells.home(vectors, _salt(b.column(0).to_numpy()[places]))
                    visits = [v[v != h] for v, h in zip(cells.open(vectors, bounds[places], reach), home, strict=True)]
                    rows = np.repeat(places, [len(v) for v in visits])
                    blocks = np.concatenate(visits)
                    for at in range(0, len(rows), 10_000):
                        some = rows[at : at + 10_000]
                        yield _dealt(b, some, blocks[at : at + 10_000], cells, True, bounds[some])

    return run


def _projections(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, vectors in _by_size(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vectors), vectors.shape[1], np.int32)), pa.array(list(cells.project(vectors)), pa.list_(pa.float64()))], names=["size", "p"])

    return run


def _count_cells(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, vectors in _by_size(b, 0):
                size = vectors.shape[1]
                own, n = np.unique(cells.cell(cells.project(vectors), size), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), size, np.int32)), pa.array(own), pa.array(n)], names=["size", "cell", "n"])

    return run


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, v, size of the vectors that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def cells_of(vectors: DataFrame, block: int | None = None) -> Cells:
    """The cells of an index: two passes, of sketches and of counts."""
    tasks = partitions(vectors.sparkSession)
    held = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row for each vector length
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, sum(held.values()) // (2 * tasks)))
    splits = {s: min(MOST_SPLITS, s, int(np.ceil(np.log2(n / block)))) for s, n in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT] if n > block}
    cells = Cells({s: np.zeros(k) for s, k in splits.items()}, {}, block, tasks)
    if splits:
        projected = vectors.where(F.col("size").isin(*splits)).select("v").mapInArrow(_projections(cells), "size int, p array<double>")
        medians = projected.groupBy("size").agg(*[F.percentile_approx(F.get("p", F.lit(j)), 0.5, 200).alias(f"m{j}") for j in range(max(splits.values()))]).collect()  # FREQUENT rows at most
        cells.cuts = {r["size"]: np.asarray([r[f"m{j}"] for j in range(splits[r["size"]])]) for r in medians}
    counts = vectors.select("v").mapInArrow(_count_cells(cells), "size int, cell long, n long").groupBy("size", "cell").agg(F.sum("n").alias("n")).collect()  # one row for each cell
    return Cells(cells.cuts, {(r["size"], r["cell"]): r["n"] for r in counts}, block, max(tasks, -(-len(counts) // 8)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block: int | None = None, verified: float | None = VERIFIED, reach: float | None = REACH) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id, v, size (see ``usable``).  ``verified=None, reach=None``: exact."""
    if k < 1:
        raise ValueError("k must be at least 1")
    cells = cells_of(vectors, block)
    rows = vectors.select("vec_id", "v").mapInArrow(_deal_home(cells, False), _DEALT)

    def searched(asked: DataFrame, name: str) -> DataFrame:
        dealt = rows.unionByName(asked).repartitionById(cells.tasks, "task").sortWithinPartitions("block", "query")
        return materialise(dealt.select("block", "query", "vec_id", "v", "bound").mapInArrow(_search(k, verified), "query_id long, vec_id long, score double"), name)

    found = searched(queries.select("vec_id", "v").mapInArrow(_deal_home(cells, True), _DEALT), "ann-home")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if cells.blocks > 1:
        kth = once(found).where(F.col("rank") == k).select(F.col("query_id").alias("_w_query"), F.col("score").alias("_w_kth"))
        bounded = queries.join(kth, F.col("vec_id") == F.col("_w_query"), "left").select("vec_id", "v", F.coalesce("_w_kth", F.lit(float("-inf"))).alias("bound"))
        found = found.unionByName(searched(bounded.mapInArrow(_deal_on(cells, reach), _DEALT), "ann-found"))
    return once(found).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
