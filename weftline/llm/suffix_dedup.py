"""Suffix-array dedup: byte strings of ``LENGTH`` that start earlier too are removed.

A sparse suffix array is built by a distributed merge sort that knows common
prefixes, over the suffixes that can matter:

1. *Leaders.*  A window of ``LENGTH`` bytes is led by the place in it whose
   ``CORE`` bytes hash smallest (the leftmost such place): equal windows are
   led from the same offset.  About one place in 35 leads any window.  Places
   whose core occurs only once in the corpus lead windows that cannot repeat
   and are left out (``repeats``).
2. *Runs.*  Each task sorts the suffixes at its remaining leaders, as far as
   their windows reach, and keeps of equal ones the first (the others are
   settled on the spot).  A run is exchanged front-coded: for each suffix the
   length of the prefix it shares with the one before, and the rest; besides,
   the bytes left of the leader that its windows reach.
3. *Merge.*  A loser tree merges the runs of a range of cores.  Its nodes hold
   the common prefix of their suffix with the last one taken, so a comparison
   begins where the two can differ and no known prefix is compared again.  What
   comes out is the sorted order with its common-prefix lengths.
4. *Windows.*  For each offset from the leader, suffixes whose common prefix
   covers the right part of the window form a run of that order; within it,
   equal left parts (by two hashes, and by their bytes where these disagree)
   make equal windows, and all but the first by (doc_id, start) are lost.  This is linear in the windows of a group and never looks
   at pairs.
5. Lost windows of a document merge into maximal spans.

A core that more than ``CROWD`` texts have (the edge of a very common passage
gives one suffix for each document) would put them all into one merge.  The
windows under such cores are exchanged by their own content (128 bits of hash)
instead, after each task has settled those that it has twice.  So a part, of
which a task holds one at a time, has no core with more suffixes than that.

Copies of a whole text are found by its hash and lose all bytes at once.
Texts are exchanged once, by document; both joins read that exchange.

Defined cases: a null or empty text has no bytes; texts shorter than
``LENGTH`` lose nothing; overlapping repeats inside a document count; rows with
the same doc_id and text are one row here, rows with the same doc_id and other
texts are ordered by start; a null doc_id counts as the smallest; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, text_slices
from .repeats import PORTION, copies, doc_id, first_of, shared_leaders, with_identity
from .rolling import U, byte_symbols, powers, sliding_min, windows

LENGTH = 100
CORE = 32
#: Suffixes in a run, and in how many parts (times the shuffle partitions) runs are cut.
RUN = 150_000
PARTS = 8
CROWD = 20_000
_PLACE = U((1 << 31) - 1)


def led_windows(raw: bytes, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leader places with the hash of their cores, and the first and last window that each leads."""
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none.view(U), none, none
    hashes = windows(byte_symbols(raw), core)
    # The low bits hold the place: of equal hashes the leftmost is the least.
    least = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=U), length - core + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    place = (least[first] & _PLACE).astype(np.int64)
    return place, hashes[place], first, np.r_[first[1:], len(least)] - 1


class LoserTree:
    """Merges sorted runs of byte strings, given each string's common prefix with the one before it in its run.

    ``take`` gives (run, common prefix with the string taken before), or None.
    Each loser holds its common prefix with the winner that beat it, which the
    order makes its common prefix with every later winner up to its own turn.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.strings = [s for s, _ in runs]
        self.shared = [c for _, c in runs]
        self.at = [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.current: list[bytes | None] = [s[0] if s else None for s in self.strings] + [None] * (self.size - len(runs))
        self.known = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two runs; the other one stays at the node."""
        x, y = self.current[a], self.current[b]
        if y is None or x is None:
            if x is None:
                a, b = b, a
            self.loser[node] = b
            return a
        known = self.known
        i, j = known[a], known[b]
        if i == j:
            n = min(len(x), len(y))
            if x[i:n] == y[i:n]:
                i = n
            else:
                while x[i] == y[i]:
                    i += 1
            if i < n and x[i] > y[i] or i == n and len(x) > len(y):
                a, b = b, a
            known[b] = i
        elif i < j:
            a, b = b, a
        self.loser[node] = b
        return a

    def take(self) -> tuple[int, int] | None:
        run = self.winner
        if self.current[run] is None:
            return None
        taken = run, self.known[run]
        self.at[run] += 1
        place, held = self.at[run], self.strings[run]
        if place < len(held):
            self.current[run] = held[place]
            self.known[run] = self.shared[run][place]
        else:
            self.current[run] = None
        node, winner = (run + self.size) // 2, run
        while node:
            winner = self._play(node, winner, self.loser[node])
            node //= 2
        self.winner = winner
        return taken


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _encode(run: list[tuple]) -> bytes:
    """A sorted run of (suffix, left, doc, place, text_hash), front-coded: numbers first, then the strings end to end."""
    before, shared, rests = b"", [], []
    suffixes, lefts, doc, place, text = zip(*run, strict=True)
    for suffix in suffixes:
        same = common_prefix(before, suffix)
        shared.append(same)
        rests.append(suffix[same:])
        before = suffix
    numbers = [np.array(x, "<u4").tobytes() for x in (shared, [len(r) for r in rests], [len(x) for x in lefts])]
    numbers += [np.array(x, "<i8").tobytes() for x in (doc, text, place)]
    raw = b"".join([*numbers, *rests, *lefts])
    return struct.pack("<II", len(run), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


class Run(NamedTuple):
    """A decoded block."""

    suffixes: list[bytes]
    shared: list[int]
    lefts: list[bytes]
    doc: np.ndarray
    text: np.ndarray
    place: np.ndarray


def _decode(block: bytes) -> Run:
    n, size = struct.unpack_from("<II", block)
    raw = pa.decompress(block[8:], size, codec="zstd", asbytes=True)
    shared, rest, left = (np.frombuffer(raw, "<u4", n, 4 * n * i).tolist() for i in range(3))
    doc, text, place = (np.frombuffer(raw, "<i8", n, 12 * n + 8 * n * i) for i in range(3))
    at, suffixes, before = 36 * n, [], b""
    for same, more in zip(shared, rest, strict=True):
        before = before[:same] + raw[at : at + more]
        suffixes.append(before)
        at += more
    lefts = []
    for more in left:
        lefts.append(raw[at : at + more])
        at += more
    return Run(suffixes, shared, lefts, doc, text, place)


#: A block has a part; a window stands for itself by two hashes, of which the first is in the place of the part.
_SENT = "part long, key2 long, block binary, doc long, text_hash long, start long, stop long, settled boolean"
_NAMES = ["part", "key2", "block", "doc", "text_hash", "start", "stop", "settled"]


def _sent(part, key2, block, doc, text, start, stop, settled: bool) -> pa.RecordBatch:
    n = len(part)
    columns = [pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64()) for x in (part, key2, doc, text, start, stop)]
    blocks = pa.array(block, pa.binary()) if block is not None else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([*columns[:2], blocks, *columns[2:], pa.array(np.full(n, settled))], names=_NAMES)


def _settle_windows(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """The first of each window goes on, the others are lost here; neighbours of one document as one span."""
    by = np.lexsort((start, doc, key2, key))
    key, key2, doc, text, start = key[by], key2[by], doc[by], text[by], start[by]
    new = first_of(key, key2)
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    lost = (doc != doc[at]) | (start != start[at])
    yield _sent(key[new], key2[new], None, doc[new], text[new], start[new], start[new] + length, False)
    doc, text, start = doc[lost], text[lost], start[lost]
    by = np.lexsort((start, text, doc))
    doc, text, start = doc[by], text[by], start[by]
    if len(doc):
        new = first_of(doc, text)
        new[1:] |= start[1:] > start[:-1] + 1
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(doc)] - 1
        yield _sent(np.zeros(len(first), np.int64), None, None, doc[first], text[first], start[first], start[last] + length, True)


def _send_runs(length: int, core: int, parts: int):
    """(doc, text, text_hash, leaders, crowded, is_copy) -> front-coded runs, one block for each part, crowded windows, and settled spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        crowd: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort()  # by part, suffix, left, doc, place
            settled, blocks, run_, before = [], [], [], None
            for part, suffix, left, doc, place, text in held:
                if before is not None and before[:3] == (part, suffix, left):
                    if before[3:] != (doc, place):
                        settled.append((doc, text, place - len(left), place + len(suffix)))
                    continue
                if before is not None and before[0] != part:
                    blocks.append((before[0], _encode(run_)))
                    run_ = []
                run_.append((suffix, left, doc, place, text))
                before = (part, suffix, left, doc, place)
            if run_:
                blocks.append((before[0], _encode(run_)))
            held.clear()
            if settled:
                yield _sent([0] * len(settled), None, None, *zip(*settled, strict=True), True)
            for at in range(0, len(blocks), 64):
                part, block = zip(*blocks[at : at + 64], strict=True)
                yield _sent(part, None, block, None, None, None, None, False)

        def flush_crowd() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if crowd:
                yield from _settle_windows(*(np.concatenate(c) for c in zip(*crowd, strict=True)), length)
            crowd.clear()
            size = 0

        for b in batches:
            docs, hashes, is_copy = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist()
            for start, texts in text_slices(b, 1):
                for i, text in enumerate(texts, start):
                    if is_copy[i] or not text or not b.column(3)[i].is_valid:
                        continue
                    raw = text.encode()
                    place, key, first, last = led_windows(raw, length, core)
                    wanted = np.isin(key, b.column(3)[i].values.to_numpy().view(U))
                    many = b.column(4)[i].values.to_numpy().view(U)
                    if len(many):
                        full = np.isin(key, many)
                        wanted &= ~full
                        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(p, to + 1) for p, to in zip(first[full].tolist(), last[full].tolist(), strict=True))])
                        crowd.append((*(windows(byte_symbols(raw), length, which)[at].view(np.int64) for which in (0, 1)), np.full(len(at), docs[i]), np.full(len(at), hashes[i]), at))
                        size += len(at)
                    part = (key[wanted] % U(parts)).tolist()
                    for k, q, p, to in zip(part, place[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                        held.append((k, raw[q : to + length], raw[p:q], docs[i], q, hashes[i]))
                if len(held) >= RUN:
                    yield from flush()
                if size >= PORTION:
                    yield from flush_crowd()
        if held:
            yield from flush()
        yield from flush_crowd()

    return run


def lost_spans(order: list[tuple[bytes, bytes]], shared: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """(first, last) lost window of each suffix, relative to its leader; (1, 0) if none.

    order: (suffix, left) in sorted order; shared: common prefix with the one
    before; rank: the place of each in the order of (doc, place).
    """
    n = len(order)
    right = np.fromiter((len(s) for s, _ in order), np.int64, n)
    left = np.fromiter((len(x) for _, x in order), np.int64, n)
    widest = int(left.max()) if n else 0
    # Two hashes of the o bytes before the leader, for each o.
    flat = np.frombuffer(b"".join(x[::-1].ljust(widest, b"\0") for _, x in order), np.uint8).reshape(n, widest) if widest else np.zeros((n, 0), np.uint8)
    by_rank = np.argsort(rank, kind="stable")
    found = np.tile(np.array([1 << 30, -(1 << 30)]), (n, 1))
    sums, sums2 = np.zeros(n, U), np.zeros(n, U)
    scale, scale2 = powers(widest + 1) * U(0xD6E8FEB86659FD93), powers(widest + 1, which=1) * U(0xA0761D6478BD642F)
    for o in range(widest + 1):
        if o:
            byte = flat[:, o - 1].astype(U) + U(1)
            sums = sums + byte * scale[o]
            sums2 = sums2 + byte * scale2[o]
        needed = length - o
        group = np.cumsum(shared < needed).astype(U)
        able = (left >= o) & (right >= needed)
        some = by_rank[able[by_rank]]
        if len(some) < 2:
            continue
        key = (group[some] * U(0x9E3779B97F4A7C15)) ^ sums[some]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        leading = some[first][inverse]
        if ((group[some] != group[leading]) | (sums2[some] != sums2[leading])).any():
            # Different windows with one key: tell them apart by their bytes.
            numbers: dict[tuple[int, bytes], int] = {}
            exact = [numbers.setdefault((int(group[i]), order[i][1][len(order[i][1]) - o :]), len(numbers)) for i in some.tolist()]
            _, first, inverse = np.unique(exact, return_index=True, return_inverse=True)
            leading = some[first][inverse]
        lost = some[rank[some] > rank[leading]]
        found[lost, 0] = np.minimum(found[lost, 0], -o)
        found[lost, 1] = np.maximum(found[lost, 1], -o)
    return found


def _merge_part(blocks: list[bytes], length: int) -> pa.RecordBatch | None:
    runs = [_decode(b) for b in blocks]
    tree = LoserTree([(r.suffixes, r.shared) for r in runs])
    base = np.cumsum([0, *(len(r.suffixes) for r in runs)])
    order, shared, source = [], [], []
    at = [0] * len(runs)
    while (taken := tree.take()) is not None:
        r, same = taken
        k = at[r]
        at[r] = k + 1
        order.append((runs[r].suffixes[k], runs[r].lefts[k]))
        shared.append(same)
        source.append(base[r] + k)
    doc, text, place = (np.concatenate([getattr(r, c) for r in runs])[source] for c in ("doc", "text", "place"))
    by = np.lexsort((place, doc))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.r_[False, (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])])
    shared[0] = 0
    found = lost_spans(order, np.asarray(shared), rank, length)
    hit = np.flatnonzero(found[:, 0] <= found[:, 1])
    if not len(hit):
        return None
    start, stop = place[hit] + found[hit, 0], place[hit] + found[hit, 1] + length
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[hit], text[hit], start, stop)], names=["doc", "text_hash", "start", "stop"])


def _merge_runs(length: int):
    """Rows sorted by part, key2, doc, start -> lost spans.  Of the blocks, those of one part are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        window: tuple[int, int, int, int] | None = None  # the open window's hashes, and where it is first
        for b in batches:
            settled, coded = b.column(7).to_numpy(zero_copy_only=False), b.column(2).is_valid().to_numpy(zero_copy_only=False)
            plain = np.flatnonzero(~settled & ~coded)
            lost = np.flatnonzero(settled)
            if len(plain):
                key, key2, doc, start = (b.column(i).take(pa.array(plain)).to_numpy() for i in (0, 1, 3, 5))
                new = first_of(key, key2)
                new[0] = window is None or window[:2] != (key[0], key2[0])
                group = np.cumsum(new)
                firsts = [(0, 0) if window is None else window[2:], *zip(doc[new].tolist(), start[new].tolist(), strict=True)]
                at = np.array(firsts, np.int64)[group]
                lost = np.sort(np.r_[lost, plain[(doc != at[:, 0]) | (start != at[:, 1])]])
                window = (int(key[-1]), int(key2[-1]), int(at[-1, 0]), int(at[-1, 1]))
            if len(lost):
                yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(lost)) for i in (3, 4, 5, 6)], names=_NAMES[3:7])
            held = b.filter(pa.array(coded))
            for p, block in zip(held.column(0).to_pylist(), held.column(2), strict=True):
                if p != part and blocks:
                    if (found := _merge_part(blocks, length)) is not None:
                        yield found
                    blocks = []
                part = p
                blocks.append(block.as_py())
        if blocks and (found := _merge_part(blocks, length)) is not None:
            yield found

    return run


def _lost(docs: DataFrame, length: int, core: int, crowd: int = CROWD, others: list[str] | None = None) -> DataFrame:
    """``docs``' doc_id and text, starts and stops of lost spans, is_copy, and the other columns as _w_c0, ...

    Both uses of the texts ask for the same columns, so that they share one exchange.
    """
    own = with_identity(docs, others)
    along = [c for c in own.columns if c.startswith("_w_c")]
    n = partitions(docs.sparkSession)
    same = ["doc", "text_hash"]

    def leaders_of(texts: list[bytes]) -> Iterator[np.ndarray]:
        for raw in texts:
            yield led_windows(raw, length, core)[1]

    copied = copies(own)
    hints = shared_leaders(own, leaders_of, crowd).join(copied, same, "full")
    texts = own.repartition(n, *same)
    sent = texts.join(hints, same, "left").select("doc", "text", "text_hash", "leaders", "crowded", "is_copy", *along).mapInArrow(_send_runs(length, core, n * PARTS), _SENT)
    where = F.when(F.col("settled"), F.pmod(F.xxhash64("doc", "text_hash"), F.lit(n))).otherwise(F.pmod("part", F.lit(n))).cast("int")
    spans = sent.repartitionById(n, where).sortWithinPartitions("part", "key2", "doc", "start").mapInArrow(_merge_runs(length), "doc long, text_hash long, start long, stop long")
    spans = spans.groupBy(*same).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return texts.join(spans, same, "left").join(copied, same, "left").select(doc_id(), "text", "starts", "stops", "is_copy", *along)


def union(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of a union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > stops[:-1]])
    return list(zip(starts[new].tolist(), stops[np.r_[new[1:], len(stops)] - 1].tolist(), strict=True))


def _spans(row_starts, row_stops, is_copy: bool | None, n: int, length: int) -> list[tuple[int, int]]:
    if is_copy and n >= length:
        return [(0, n)]
    if not row_starts.is_valid:
        return []
    return union(row_starts.values.to_numpy(), row_stops.values.to_numpy())


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(raw[at:start])
        at = stop
    return b"".join([*kept, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the UTF-8 characters that they hold in part."""
    out = []
    for start, stop in spans:
        while start < stop and raw[start] & 0xC0 == 0x80:
            start += 1
        if stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            while raw[stop] & 0xC0 == 0x80:
                stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, 1):
                rows = []
                for i, text in enumerate(texts, start):
                    raw = (text or "").encode()
                    spans = _spans(b.column(2)[i], b.column(3)[i], b.column(4)[i].as_py(), len(raw), length)
                    rows.append((len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(cut_out(raw, spans)).hexdigest()))
                n, removed, count, digest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *(pa.array(c, pa.int64()) for c in (n, removed, count)), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _rewrite(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 3
            at = b.schema.get_field_index("text")
            for start, texts in text_slices(b, at):
                out = []
                for i, text in enumerate(texts, start):
                    if text is not None:
                        raw = text.encode()
                        spans = whole_characters(raw, _spans(b.column(n)[i], b.column(n + 1)[i], b.column(n + 2)[i].as_py(), len(raw), length))
                        text = cut_out(raw, spans).decode()
                    out.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else b.column(k).slice(start, len(texts)) for k in range(n)], names=b.schema.names[:n])

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``docs`` with its columns, repeated strings gone from ``text``; a character stays whole or goes whole."""
    held = docs.withColumn("text", F.col("text").cast("string"))
    others = [c for c in held.columns if c != "text"]
    found = _lost(held, length, core, others=others)
    own = [F.col("text") if c == "text" else F.col(f"_w_c{others.index(c)}").alias(c) for c in held.columns]
    ends = [F.col(c).alias(f"_w_{c}") for c in ("starts", "stops", "is_copy")]
    return found.select(*own, *ends).mapInArrow(_rewrite(length), held.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lost(documents(spark, sf_dir), LENGTH, CORE).select("doc_id", "text", "starts", "stops", "is_copy")
    return found.mapInArrow(_digest(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP10_SQL = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as x from documents),
s as (select doc_id, unnest(range(0, greatest(length(x) // 2 - 99, 0))) as p, x from d where length(x) >= 200),
h as (select doc_id, p, md5(substr(x, 2 * p + 1, 200)) as win from s),
o as (select *, row_number() over (partition by win order by doc_id, p) as nth from h),
r as (select doc_id, p, p + 100 as e from o where nth > 1),
m as (select *, max(e) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as before from r),
g as (select *, sum(case when before is null or p > before then 1 else 0 end) over (partition by doc_id order by p) as span from m),
v as (select doc_id, span, min(p) as p, max(e) as e from g group by doc_id, span),
a as (select v.doc_id, v.p, v.e, coalesce(lag(v.e) over (partition by v.doc_id order by v.p), 0) as since from v),
k as (select a.doc_id, count(*) as n_spans, sum(a.e - a.p) as n_removed, max(a.e) as last, string_agg(substr(d.x, 2 * a.since + 1, 2 * (a.p - a.since)), '' order by a.p) as head from a join d on a.doc_id = d.doc_id group by a.doc_id)
select d.doc_id, cast(length(d.x) // 2 as bigint) as n_bytes, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, cast(coalesce(k.n_spans, 0) as bigint) as n_spans,
 sha256(unhex(coalesce(k.head, '') || substr(d.x, 2 * coalesce(k.last, 0) + 1))) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
