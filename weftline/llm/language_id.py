"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: 1- to 3-grams of the lower-cased text with every run of
  non-letters as one space, hashed to ``BUCKETS``; weight (1 + log tf) * idf,
  rows scaled to length 1.
* Document frequencies are counted over all training documents, in one
  distributed pass; tasks send the buckets that they saw.
* The classifier is fitted on at most ``SAMPLE`` training documents (dealt
  evenly to the languages, chosen by a hash), by FTRL-proximal with elastic
  net (l1 and l2); most weights of the buckets seen are zero.  A fifth of the
  sample is held back to fit the temperature, with smoothed targets.
* The sample's features lie in the shared folder.  The driver holds them if they
  have 256 MB at most, else reads them a partition at a time in each epoch;
  order and result are the same.
* Prediction is a map over whole texts.  What goes to the workers is the idf
  vector and the weights: BUCKETS x (1 + languages) numbers, whatever the
  corpus.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any training document every text is ``und``; with one language every
other text gets that one with score 1; a null doc_id is not held out and not
learned from; rows with the same doc_id stay separate rows; other columns are
ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, text_slices

logger = logging.getLogger(__name__)
BUCKETS = 1 << 16
SAMPLE = 4000
EPOCHS = 4
#: Elastic net: l1 makes weights zero, l2 shrinks them.
L1, L2 = 0.2, 1e-3
UNKNOWN = "und"
_PART = 1 << 22
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a whole text; none if it has no letter."""
    text = text or ""
    counts: np.ndarray | None = None
    for at in range(0, len(text), _PART):
        code = np.frombuffer(text[max(0, at - 2) : at + _PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        if not letter.any():
            continue
        code = np.where(letter, code, np.uint32(32))
        code = np.r_[np.uint32(32), code[letter | np.r_[True, letter[:-1]]], np.uint32(32)]
        one = code * _MIX[0]
        two = (one[:-1] ^ (code[1:] + np.uint32(1))) * _MIX[1]
        three = (two[:-1] ^ (code[2:] + np.uint32(2))) * _MIX[2]
        shift = np.uint32(32 - (buckets.bit_length() - 1))
        found = np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]), minlength=buckets)
        counts = found if counts is None else counts + found
    if counts is None:
        return np.zeros(0, np.int64), np.zeros(0)
    where = np.flatnonzero(counts)
    return where, counts[where].astype(np.float64)


def weigh(where: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[where]
    return x / max(np.sqrt(x @ x), 1e-12)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(where, counts, self.idf) @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        where, counts = features(text, len(self.idf))
        if not len(where) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(where, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], n_features: int, n_classes: int, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal, one step per row (places, values, class) of each epoch; the bias is not penalised by l1."""
    z = np.zeros((n_features + 1, n_classes))
    n = np.zeros_like(z)
    penalty = np.full((n_features + 1, 1), l1)
    penalty[-1] = 0.0

    def weights(zs: np.ndarray, ns: np.ndarray, l1s: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1s, 0.0, -(zs - np.sign(zs) * l1s) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for where, x, y in rows():
            where, x = np.r_[where, n_features], np.r_[x, 1.0]
            zs, ns = z[where], n[where]
            w = weights(zs, ns, penalty[where])
            error = softmax(x @ w)
            error[y] -= 1
            g = np.outer(x, error)
            more = ns + g * g
            z[where] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[where] = more
    w = weights(z, n, penalty)
    return w[:-1], w[-1]


#: Where the search for a temperature begins and ends.
_COLDEST, _HOTTEST = 0.02, 50.0


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm.

    Targets are smoothed as in Platt scaling, by one more row than there are for
    each class: the right class counts (n + 1) / (n + classes), so that rows that
    are all predicted rightly do not ask for a temperature of zero.
    """
    if not len(classes) or logits.shape[1] < 2:
        return 1.0
    n, width = logits.shape
    target = np.full((n, width), 1 / (n + width))
    target[np.arange(n), classes] += n / (n + width)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((target * (np.log(np.exp(z).sum(1, keepdims=True)) - z)).sum(1).mean())

    lo, hi, r = np.log(_COLDEST), np.log(_HOTTEST), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    found = float(np.exp((lo + hi) / 2))
    if not 1.01 * _COLDEST < found < 0.99 * _HOTTEST:
        logger.warning("the temperature %.3g is an end of the search, not a calibration", found)
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many documents hold each bucket (lang null), and how many each language has (bucket -1)."""
    found, langs = np.zeros(BUCKETS, np.int64), {}
    for b in batches:
        names = b.column(1).to_pylist()
        for start, texts in text_slices(b, 0):
            for text, lang in zip(texts, names[start:], strict=False):
                where, _ = features(text)
                if len(where):
                    found[where] += 1
                    langs[lang] = langs.get(lang, 0) + 1
    held = np.flatnonzero(found)
    if langs:
        yield pa.RecordBatch.from_arrays([pa.array([*langs, *([None] * len(held))], pa.string()), pa.array([*([-1] * len(langs)), *held], pa.int32()), pa.array([*langs.values(), *found[held]], pa.int64())], names=["lang", "bucket", "n"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, texts in text_slices(b, 0):
            both = [features(t) for t in texts]
            columns = [pa.array([x[0].astype("<u2").tobytes() for x in both], pa.binary()), pa.array([x[1].astype("<u4").tobytes() for x in both], pa.binary())]
            part = pa.array(np.full(len(texts), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([*columns, *(b.column(i).slice(start, len(texts)) for i in (1, 2)), part], names=["at", "n", "lang", "order", "part"])


#: Features of more bytes than this are not held by the driver but read again, a partition at a time, in each epoch.
_HELD = 256 << 20
_SAMPLE_PARTS = 32


class _Examples:
    """The sample as (places, weights, class), in the order of a hash; ``part`` numbers of five are held back."""

    def __init__(self, table: DataFrame, idf: np.ndarray, names: list[str]) -> None:
        self.table, self.idf, self.names = table, idf, names
        size = table.agg(F.sum(F.octet_length("at") + F.octet_length("n"))).first()[0] or 0
        self.held = list(self._of(table)) if size <= _HELD else None

    def _of(self, table: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for r in sorted(table.collect(), key=lambda r: (r["order"], r["lang"])):  # SAMPLE rows at most, or a part of them
            where, counts = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.float64)
            if len(where):
                yield where, weigh(where, counts, self.idf), self.names.index(r["lang"])

    def _read(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for part in range(_SAMPLE_PARTS):  # parts follow each other in the order of the hash
            yield from self._of(self.table.where(F.col("part") == part))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        return iter(self.held) if self.held is not None else self._read()

    def part(self, held_back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        return (x for i, x in enumerate(self) if (i % 5 == 0) == held_back)


def train(labelled: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, l1: float = L1) -> Model:
    """Fit on rows (text, lang, order); ``order`` is a hash that picks the sample and nothing else."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", "order")
    counted = rows.select("text", "lang").mapInArrow(_frequencies, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # one row for each bucket and language
    langs = {r["lang"]: r["n"] for r in counted if r["bucket"] < 0}
    if not langs:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    frequency = np.zeros(BUCKETS)
    for r in counted:
        if r["bucket"] >= 0:
            frequency[r["bucket"]] = r["n"]
    total = sum(langs.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    names = sorted(langs)
    each = max(1, sample // len(names))
    share = F.create_map(*[F.lit(v) for name in names for v in (name, min(1.0, 1.5 * each / langs[name] + 50 / langs[name]))])[F.col("lang")]
    near = rows.where(F.pmod("order", F.lit(1_000_003)) < share * 1_000_003)
    # Ties of the hash (rows with one doc_id) are broken by the text's hash, repeated rows by nothing: they are alike.
    chosen = near.withColumn("_w_t", F.xxhash64("text")).withColumn("_w_n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "_w_t"))).where(F.col("_w_n") <= each)
    mixed = F.xxhash64(F.lit(5), "order", "_w_t")
    dealt = chosen.select("text", "lang", mixed.alias("order")).repartitionByRange(_SAMPLE_PARTS, "order").sortWithinPartitions("order", "lang")
    table = materialise(dealt.mapInArrow(_sample, "at binary, n binary, lang string, order long, part int"), "language-sample")
    examples = _Examples(table, idf, names)
    few = next(examples.part(False), None) is None
    weights, bias = fit_ftrl(lambda: examples if few else examples.part(False), BUCKETS, len(names), epochs, l1=l1)
    held_back = list(_logits(examples.part(True), weights, bias))
    return Model(names, idf, weights, bias, fit_temperature(np.array([z for z, _ in held_back]).reshape(-1, len(names)), np.array([y for _, y in held_back], np.int64)))


def _logits(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], weights: np.ndarray, bias: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    for where, x, y in rows:
        yield x @ weights[where] + bias, y


def training_rows(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang", F.xxhash64("doc_id").alias("order"))


def _predict(model: Model):
    light = model._replace(weights=model.weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for start, texts in text_slices(b, at):
                found = [light.predict(t) for t in texts]
                columns = [b.column(i).slice(start, len(texts)) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` and two columns more; only ``text`` is looked at."""
    held = docs.withColumn("text", F.col("text").cast("string"))
    plain = held.toDF(*[c if c == "text" else f"_w_c{i}" for i, c in enumerate(held.columns)])
    schema = plain.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return plain.mapInArrow(_predict(model), schema).toDF(*held.columns, label, score)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(own, train(training_rows(docs))).select("doc_id", "held_out", "lang_pred", "score")
