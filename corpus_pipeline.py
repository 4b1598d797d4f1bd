"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``; ``n_chars`` follows the text.

1. ``language_id``: documents without any letter, or whose calibrated language
   probability is below ``MIN_SCORE``, go; where no row has a language to learn
   from, only the former.
2. ``line_dedup``: lines found in 10 documents or more go, all of them; but of
   documents that such lines make up by half or more (groups of copies), the
   first holder of each line keeps it.
3. ``simhash``: of documents linked by likeness (Jaccard 0.8 or more of their
   sets of five-word shingles) the one with the smallest doc_id stays.  SimHash
   gives the links within three bits, a prefix filter those beyond; sets decide.
4. ``suffix_dedup``: strings of 100 bytes that start earlier too go; a character
   goes whole or stays whole.
5. ``packing``: what is left, in sequences of 2048 tokens.

Rows of any shape pass: see the operators' docstrings for nulls, empty texts,
repeated rows and further columns.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import documents, materialise, prepare, release, written
from weftline.llm.language_id import UNKNOWN, has_letter, predict, train, training_rows
from weftline.llm.line_dedup import drop_lines_but_copies
from weftline.llm.near_copies import keep_one_alike
from weftline.llm.packing import pack
from weftline.llm.suffix_dedup import drop_repeats

#: Documents whose language is less probable than this go.
MIN_SCORE = 0.5
SHINGLE_WORDS = 5
#: Words whose ids a worker remembers in the last stage, beside what the stages before left in its memory.
CHUNKS = 120_000


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = train(training_rows(docs))
    if not model.languages:
        return docs.where(F.udf(has_letter, "boolean", useArrow=True)(F.col("text").cast("string")))
    found = predict(docs, model, "_w_lang", "_w_score")
    return found.where((F.col("_w_lang") != UNKNOWN) & (F.col("_w_score") >= MIN_SCORE)).drop("_w_lang", "_w_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(drop_lines_but_copies(docs))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_alike(docs, words=SHINGLE_WORDS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(drop_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(docs, memory=CHUNKS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Tokenising and fingerprints have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the shared folder; all other tables that the run wrote there are gone."""
    docs, before = documents(spark, sf_dir), written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since=before, keep=1)
    return docs
