"""Rabin-Karp hashes of all windows of many texts at once, in numpy.

A window's hash is a difference of prefix sums: with ``P[i] = sum(x[j] * B**j
for j < i)`` modulo 2**64, ``(P[e] - P[s]) * B**-s`` depends on the content of
``x[s:e]`` alone (B is odd, so it has an inverse).  The symbols are random
64-bit numbers and the result is mixed, so sums modulo a power of two do no
harm.  Where equality decides what is removed, a second hash with another base
stands beside the first: 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Two odd bases and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: One random number for each byte.
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are hashed so many bytes at a time; longer ones are cut at white space.
AT_ONCE = 1 << 20


@lru_cache(maxsize=16)
def _powers(bits: int, inverse: bool, which: int) -> np.ndarray:
    steps = np.full(1 << bits, (_INVERSES if inverse else _BASES)[which], U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(n: int, inverse: bool = False, which: int = 0) -> np.ndarray:
    """B**0 ... B**(n - 1), or of the inverse."""
    return _powers(max(10, (n - 1).bit_length() if n > 1 else 1), inverse, which)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(symbols: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols), which=which), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of [start, stop) from prefix sums."""
    return mix((sums[stop] - sums[start]) * powers(len(sums), inverse=True)[start])


def windows(symbols: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each window of ``length`` symbols; ``which``: the first or the second hash."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    if which:
        symbols = mix(symbols ^ U(0xA5A5A5A5A5A5A5A5))
    sums = prefix(symbols, which)
    return mix((sums[length:] - sums[:n]) * powers(n, inverse=True, which=which))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    held, have = x, 1
    while have * 2 <= width:
        held = np.minimum(held[:-have], held[have:]) if len(held) > have else held[:0]
        have *= 2
    rest = width - have
    if rest:
        held = np.minimum(held[:-rest], held[rest:]) if len(held) > rest else held[:0]
    return held


def byte_symbols(raw: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(raw, np.uint8)]


def _words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word; ``raw`` ends with white space."""
    data = np.frombuffer(raw, np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.r_[0, edge]
    start, stop = edge[0::2], edge[1::2]
    return start, spans(prefix(_BYTE[data]), start, stop) + mix((stop - start).astype(U))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the hashes of its words (runs of other than white space)."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            start, hashes = _words_of(b" ".join(held) + b" ")
            ends = np.cumsum([len(t) + 1 for t in held])
            out.extend(np.split(hashes, np.searchsorted(start, ends[:-1])))
            held.clear()
            size = 0

    for text in texts:
        if len(text) > AT_ONCE:
            flush()
            parts, at = [], 0
            while at < len(text):
                stop = at + AT_ONCE
                while stop < len(text) and not SPACE[text[stop]]:
                    stop += 1
                parts.append(_words_of(text[at:stop] + b" ")[1])
                at = stop
            out.append(np.concatenate(parts))
            continue
        held.append(text)
        size += len(text)
        if size >= AT_ONCE:
            flush()
    flush()
    return out
