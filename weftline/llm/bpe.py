"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary itself.

The model file is serialised here from the ranks (no training): each piece is
a vocabulary entry with its bytes mapped to letters, its score the negative
rank; normalisation is the identity.  sentencepiece merges the adjacent pair
whose union has the highest score, the leftmost first, which is the lowest
rank first, as the rank file asks.  A pre-token that is an entry itself keeps
its own rank, as in the format's own encoder.

Defined cases: a null or empty text has no ids and decodes to no bytes; special
tokens are ordinary text; rows with the same doc_id stay separate rows; an
empty table gives no rows; other columns are ignored.  Memory is bounded by
the chunk memory and a few MB of text at a time, whatever a text's length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkMemo
from .common import documents, text_columns

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes 0-255 stand as U+0100-U+01FF: letters that no normalisation touches.
_SHIFT = 0x100
_AS_LETTERS = {b: chr(_SHIFT + b) for b in range(256)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_AS_LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece r + 1 the entry of rank r."""
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [unknown, *(_field(1, letters(p).encode()) + _field(2, float(-r)) for p, r in by_rank)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """encode() and decode() for one vocabulary."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.pieces = [p for p, _ in sorted(self.ranks.items(), key=lambda item: item[1])]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.codes = [struct.pack("<I", i) for i in range(len(self.pieces))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.memo = ChunkMemo(self._encode_chunks)

    def _encode_chunks(self, texts: list[str]) -> list[bytes]:
        # A chunk of ASCII letters is a pre-token as it is.
        cut = [[t] if (w := t[1:] if t[:1] == " " else t).isascii() and w.isalpha() else self.split(t) for t in texts]
        known: dict[str, bytes] = {}
        open_ = []
        for token in {t for tokens in cut for t in tokens}:
            raw = token.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                open_.append((token, letters(raw)))
            else:
                known[token] = self.codes[rank]
        if open_:
            for (token, _), ids in zip(open_, self.model.encode([x for _, x in open_], out_type=int, num_threads=1), strict=True):
                known[token] = (np.array(ids, "<u4") - np.uint32(1)).tobytes()
        return [known[tokens[0]] if len(tokens) == 1 else b"".join(map(known.__getitem__, tokens)) for tokens in cut]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        ids, ends = self.memo.ids(texts)
        return np.split(ids, ends[:-1]) if len(ends) else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """One for each vocabulary in a Python worker, kept between tasks."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path or vocabulary_path())
        for b in batches:
            for start, texts in text_columns(b, 1):
                ids = [x.astype(np.int32) for x in bpe.encode_column(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path or vocabulary_path())
        for b in batches:
            decoded = [bpe.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


#: Ids of a text that are written and decoded at a time.
_AT_ONCE = 1 << 18


def _digest(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path or vocabulary_path())
        for b in batches:
            for start, texts in text_columns(b, 1):
                n, of_ids, of_bytes = [], [], []
                for ids in bpe.encode_column(texts):
                    written, decoded = hashlib.sha256(), hashlib.sha256()
                    for at in range(0, len(ids), _AT_ONCE):
                        some = ids[at : at + _AT_ONCE].tolist()
                        written.update((" " * bool(at) + " ".join(map(bpe.names.__getitem__, some))).encode())
                        decoded.update(bpe.decode(some))
                    n.append(len(ids))
                    of_ids.append(written.hexdigest())
                    of_bytes.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(_digest(None), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
