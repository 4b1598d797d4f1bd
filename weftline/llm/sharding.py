"""Sharding by Hilbert-curve order, in DataFrame functions only.

Several metadata dimensions are quantised, the curve index of the cell orders
the rows, and equal runs of that order are the shards.  Files written from one
shard therefore cover a compact box of the metadata space and prune on each of
the dimensions.

Steps, and what each costs at scale:

1. one pass over the texts leaves a narrow table (id, size, CRC, text hash,
   dimensions) in the shared folder; the texts are never shuffled;
2. quantile cut points (a fixed number per dimension) are exact: distinct values
   are counted over all rows and sorted by range;
3. a group of equal texts takes the curve cell of its smallest doc_id: one
   aggregate of narrow rows, joined back by the text hash.  Large groups
   (100,000 at most) come back by broadcast and never meet in one task;
4. one range exchange of narrow rows by (curve, text hash, own cell, id): a hot value of
   any dimension, or a group of equal texts, spreads over as many partitions as
   its rows need because the id is part of the key;
5. the row number in the sorted partition comes with the row
   (``monotonically_increasing_id``), the start of each partition from a table
   with one row per partition, so nothing is ranked in one task.

Law ``rows``: counts are at most one apart, ``shard = rank * shards div n``.
Equal texts (a null text is equal to an empty one) lie next to each other in
the order, whatever their metadata; a group is cut only where a shard ends.

Defined cases: null text counts 8 bytes and CRC 0, like an empty one; null
metadata is a cell of its own, below all others; repeated rows are kept and
each gets a slot of its own; an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, left_join_spread, materialise, partitions

BITS = 5
SHARDS = 24


def hilbert_index(cells: DataFrame, axes: Sequence[str], bits: int, out: str) -> DataFrame:
    """Add the Hilbert index of the cell given by integer columns ``axes`` (each below 2**bits).

    The transposition of Skilling (2004), unrolled to column arithmetic: one
    projection for each step, so that no expression is repeated.
    """
    x = [f"_w_x{i}" for i in range(len(axes))]
    df = cells.withColumns({c: F.col(a).cast("long") for c, a in zip(x, axes, strict=True)})
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i, c in enumerate(x):
            is_set = F.col(c).bitwiseAND(F.lit(q)) != 0
            if i == 0:
                df = df.withColumn(c, F.when(is_set, F.col(c).bitwiseXOR(F.lit(p))).otherwise(F.col(c)))
                continue
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(F.lit(p))
            df = df.withColumn("_w_t", F.when(is_set, F.lit(0)).otherwise(swap))
            df = df.withColumns({
                x[0]: F.when(is_set, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0]).bitwiseXOR(F.col("_w_t"))),
                c: F.col(c).bitwiseXOR(F.col("_w_t")),
            })
    for before, c in zip(x, x[1:], strict=False):
        df = df.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    flip: Column = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_w_t", flip).withColumns({c: F.col(c).bitwiseXOR(F.col("_w_t")) for c in x})
    index: Column = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(c), level).bitwiseAND(F.lit(1)))
    return df.withColumn(out, index).drop("_w_t", *x)


def _cuts(rows: DataFrame, axes: dict[str, str], bits: int) -> dict[str, list]:
    """Cut points of each axis (name -> type): the values at ranks ``k * count div (2**bits - 1)`` of all its rows.

    Distinct values with their counts are sorted by range; only the cut points reach the driver.
    """
    n = (1 << bits) - 1
    each = [F.struct(F.lit(i).alias("axis"), (F.col(a) if t == "string" else F.lit(None).cast("string")).alias("s"), (F.col(a) if t != "string" else F.lit(None).cast("double")).alias("d")) for i, (a, t) in enumerate(axes.items())]
    counted = rows.select(F.inline(F.array(*each))).where("s is not null or d is not null").groupBy("axis", "s", "d").agg(F.count("*").alias("n"))
    order = ["axis", "s", "d"]
    values = counted.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_w_part", F.spark_partition_id())
    values = materialise(values, "shard-values")
    parts = values.groupBy("axis", "_w_part").agg(F.sum("n").alias("_w_n"))  # a row for each partition and axis
    every = Window.partitionBy("axis").orderBy("_w_part")
    parts = parts.select("axis", "_w_part", (F.sum("_w_n").over(every) - F.col("_w_n")).alias("_w_start"), F.sum("_w_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_w_all"))
    within = F.sum("n").over(Window.partitionBy("axis", "_w_part").orderBy("s", "d"))
    ranked = values.withColumn("_w_to", within).join(F.broadcast(parts), ["axis", "_w_part"]).withColumn("_w_to", F.col("_w_to") + F.col("_w_start"))
    k = f"greatest(1, ((_w_to - n) * {n} + _w_all - 1) div _w_all)"
    found = ranked.where(f"{k} < {n} and ({k} * _w_all) div {n} < _w_to").select(*order).orderBy(*order).collect()
    return {a: [r["s"] if t == "string" else r["d"] for r in found if r["axis"] == i] for i, (a, t) in enumerate(axes.items())}


def _cell(column: Column, cuts: Sequence[float | str]) -> Column:
    """0 for null, else one more than the number of sorted cuts that are at most the value: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def _with_groups_cell(placed: DataFrame, n: int) -> DataFrame:
    """The curve index of the smallest doc_id of each group of equal texts, for all its rows."""
    first = F.min(F.struct("doc_id", "curve")).alias("_w_first")
    groups = placed.groupBy(F.col("_w_same").alias("_w_k0")).agg(F.count("*").alias("_w_n"), first).where("_w_n > 1").select("_w_k0", "_w_n", F.col("_w_first.curve").alias("_w_to"))
    found = left_join_spread(placed, materialise(groups, "shard-groups"), [F.col("_w_same")], n, ["_w_to"])
    return found.withColumn("_w_own", F.col("curve")).withColumn("curve", F.coalesce("_w_to", "curve")).drop("_w_to")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, dimensions: Sequence[str] = ("lang", "source", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve: one row per row of ``docs``."""
    if shards < 1 or bits < 2:
        raise ValueError("shards must be at least 1, bits at least 2")
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    dims = [d for d in dimensions if d in kinds]
    text = F.coalesce(F.col("text"), F.lit(""))
    values = [F.col(d).cast("string" if kinds[d] == "string" else "double").alias(f"_w_d{i}") for i, d in enumerate(dims)]
    narrow = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_w_same"),
            *values,
        ),
        "shard-narrow",
    )
    axes = [f"_w_d{i}" for i in range(len(dims))]
    cuts = _cuts(narrow, {a: "string" if kinds[d] == "string" else "double" for a, d in zip(axes, dims, strict=True)}, bits) if axes else {}
    # A dimension without any value orders nothing (and would be a constant in all the steps of the curve).
    used = [a for a in axes if cuts.get(a)]
    cells = narrow.withColumns({a: _cell(F.col(a), cuts[a]) for a in used}) if used else narrow
    placed = hilbert_index(cells, used, bits, "curve") if used else cells.withColumn("curve", F.lit(0).cast("long"))
    order = ["curve", "_w_same", "_w_own", "doc_id", "size"]
    ordered = _with_groups_cell(placed.drop(*axes), narrow.count()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumn("_w_place", F.monotonically_increasing_id()), "shard-order")
    ordered = ordered.withColumns({"_w_part": F.shiftright("_w_place", 33), "_w_row": F.col("_w_place").bitwiseAND(F.lit((1 << 33) - 1))})
    every = Window.orderBy("_w_part")
    starts = ordered.groupBy("_w_part").agg(F.count("*").alias("_w_n"))  # one row per partition: small whatever the input
    starts = starts.select(
        "_w_part",
        (F.sum("_w_n").over(every) - F.col("_w_n")).alias("_w_start"),
        F.sum("_w_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_w_all"),
    )
    rank = F.col("_w_start") + F.col("_w_row")
    shard = F.expr(f"(_w_rank * {shards}) div _w_all")
    return (
        ordered.join(F.broadcast(starts), "_w_part")
        .withColumn("_w_rank", rank)
        .withColumn("shard", shard.cast("int"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            F.expr(f"_w_rank - (shard * _w_all + {shards - 1}) div {shards}").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "curve",
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
