"""Token ids by memory: texts are cut where no pre-token can cross, and each distinct chunk is encoded once.

The pre-token pattern of the byte-level vocabularies never lets a match cross
the place before a space that a non-space follows: every alternative but the
white-space ones holds a space at its first place only, and a run of white
space gives up its last space to the word after it.  So a text may be cut
there, and its ids are those of its chunks in a row.

Texts whose spaces are all of that kind are cut at every space by Arrow, and
their distinct words are found by Arrow too; the ids are then put together by
numpy.  The others (a space before white space, or a text that ends in white
space) are cut by a regular expression.  Very long texts are taken in parts,
cut at the same kind of place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?= \S)")
#: What any of the libraries takes for white space, and a little more.
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"
_ODD = f" {_WHITE}|{_WHITE} \\z"
#: Longer chunks are encoded anew each time.
_LONG = 64
#: Texts of more code points are taken in parts.
_PART = 1 << 22


def chunks(text: str) -> list[str]:
    return _CUT.split(text)


def parts(text: str, size: int | None = None) -> list[str]:
    """The text in parts of about ``size`` code points, cut before spaces between letters or digits."""
    size = size or _PART
    out, at = [], 0
    while len(text) - at > size:
        stop = text.find(" ", at + size)
        while stop != -1 and not (text[stop - 1].isalnum() and text[stop + 1 : stop + 2].isalnum()):
            stop = text.find(" ", stop + 1)
        if stop == -1:
            break
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


class _Memory:
    """Ids by key, in two generations of about ``limit`` keys; what is still in use moves on to the next one."""

    def __init__(self, encode_many: Callable[[list[str]], Sequence[bytes]], limit: int) -> None:
        self.encode_many, self.limit = encode_many, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def look_up(self, keys: list[str]) -> list[bytes]:
        """The ids of each of the distinct keys."""
        found = list(map(self.young.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missing:
            if (known := self.old.get(keys[i])) is None:
                fresh.append(i)
            else:
                found[i] = self.young[keys[i]] = known
        if fresh:
            for i, ids in zip(fresh, self.encode_many([keys[i] for i in fresh]), strict=True):
                found[i] = ids
                if len(keys[i]) <= _LONG:
                    self.young[keys[i]] = ids
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return found


class ChunkMemo:
    """Ids of texts; ``encode_many`` gives the ids of chunks as little-endian unsigned 32-bit bytes.

    ``special``: texts that hold this string are given to ``encode_many`` whole.
    """

    def __init__(self, encode_many: Callable[[list[str]], Sequence[bytes]], limit: int = 400_000, special: str | None = None) -> None:
        self.encode_many, self.special = encode_many, special
        self.any = _Memory(self._encode_some, limit)
        self.after_space = _Memory(lambda words: encode_many([" " + w for w in words]), limit)

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        ids = iter(self.encode_many([t for t in texts if t]))
        return [next(ids) if t else b"" for t in texts]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        if self.special is not None:
            odd = pc.or_(odd, pc.match_substring(texts, self.special))
        odd = pc.or_(odd, pc.greater(pc.binary_length(texts), 4 * _PART)).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._even(texts)
        even, ends = self._even(texts.filter(pa.array(~odd)))
        starts = np.r_[0, ends]
        parts, at = [], 0
        for text, is_odd in zip(texts, odd.tolist(), strict=True):
            if is_odd:
                parts.append(self._odd(text.as_py()))
            else:
                parts.append(even[starts[at] : starts[at + 1]])
                at += 1
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _odd(self, text: str) -> np.ndarray:
        if self.special is not None and self.special in text:
            return np.frombuffer(self.encode_many([text])[0], "<u4")
        if len(some := parts(text)) > 1:
            return np.concatenate([self.ids(pa.array([p]))[0] for p in some])
        cut = chunks(text)
        distinct = list(set(cut))
        known = dict(zip(distinct, self.any.look_up(distinct), strict=True))
        return np.frombuffer(b"".join(map(known.__getitem__, cut)), "<u4")

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        words = split.flatten()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        first = np.r_[0, ends[:-1]]
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        known = self.after_space.look_up(coded.dictionary.to_pylist())
        # The first word of a text has no space before it.
        begins = words.take(pa.array(first)).dictionary_encode()
        code[first] = begins.indices.to_numpy(zero_copy_only=False) + len(known)
        known += self.any.look_up(begins.dictionary.to_pylist())
        table = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        start = np.cumsum(size) - size
        each = size[code]
        stop = np.cumsum(each)
        kind = np.int32 if len(stop) and max(int(stop[-1]), len(table)) < 1 << 31 else np.int64
        at = np.repeat((start[code] - (stop - each)).astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        return table[at], stop[ends - 1]
