"""Operator 4: sharding in Hilbert-curve order.

Several metadata dimensions are quantised to cells of a cube, in the order of their values and by quantiles;
documents are sorted by the index of their cell on a Hilbert curve, and the order is cut into runs. Neighbours
on the curve are neighbours in every dimension, so each run covers a range of all of them (of 16 runs over three
dimensions, a filter on one meets about half) and readers skip runs by any dimension.

Scale: the sort moves fixed-size rows (id, size, checksum, curve index), not texts. It is a range
partitioning by index and id, so a crowded cell is many partitions; ranks come from each row's place in
its partition and the partitions' counts, without one task that sees all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_bytes, written


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of coordinates below 2**bits.

    Coordinates are undone bit by bit from the highest (exchanges and inversions of the lower bits), then
    Gray-coded; the bits of all dimensions, taken in turn, are the index."""
    x = np.array(cells, np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        top, lower = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] & top) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & lower)
            x[0] = np.where(on, x[0] ^ lower, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | row >> b & 1
    return out


def curve(cells: list[Column], bits: int) -> Column:
    @F.pandas_udf("bigint")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*cells)


def value_bounds(df: DataFrame, column: str, bits: int) -> list[tuple[object, int]]:
    """The values at the quantiles i / 2**bits (0 < i < 2**bits) of all rows, null first, each with the number of
    quantiles that it holds, in order. Rows are counted by value and values ranked by ranges, so no task sees all
    of either; the driver gets the values at quantiles."""
    values = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    order = F.col("v").asc_nulls_first()
    ranged = written(values.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "hilbert-values")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(base), "part").withColumn("first", F.col("base") + F.col("within"))
    # The value with rows first to first + n - 1 holds quantile i if (total * i) >> bits is one of these.
    up_to = lambda rank: F.expr(f"least((({rank}) * {1 << bits} + total - 1) div total, {1 << bits})")
    held = placed.select("v", "first", (up_to("first + n") - F.greatest(up_to("first"), F.lit(1))).cast("int").alias("held")).filter("held > 0")
    return [(r.v, r.held) for r in sorted(held.collect(), key=lambda r: r["first"])]  # 2**bits - 1 values at most


def ordered_cells(df: DataFrame, columns: tuple[str, ...], bits: int) -> list[Column]:
    """A cell below 2**bits for each column, in the order of its values (null first), so that runs of cells are
    ranges of values: the share of rows below the row's own, by the quantiles of all rows. Frequent values have
    cells of their own."""

    def cell(column: str) -> Column:
        bounds = [value for value, held in value_bounds(df, column, bits) for _ in range(held)]
        known = [F.lit(v) for v in bounds if v is not None]
        below = F.size(F.filter(F.array(*known), lambda bound: bound < F.col(column))) if known else F.lit(0)
        return F.when(F.col(column).isNull(), 0).otherwise(below + (len(bounds) - len(known)))

    return [cell(c) for c in columns]


def shards(df: DataFrame, count: int = 8, bits: int = 6, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, curve_index): law `rows`, counts of shards
    at most one apart. A null text has size 1 and the checksum of no bytes; null metadata come first;
    null keys come first in a cell; repeated rows take a slot each; an empty table gives no rows."""
    size = (text_bytes(text) + 1).alias("size")
    names = [f"dimension_{i}" for i in range(len(categories))]
    slim = df.select(F.col(key).cast("long").alias("doc_id"), size, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), *[F.col(c).alias(n) for c, n in zip(categories, names)])
    slim = written(slim, "hilbert-rows")
    rows = slim.select("doc_id", "size", "text_crc32", curve(ordered_cells(slim, (*names, "size"), bits), bits).alias("curve_index"))
    order = [F.col("curve_index"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "hilbert-order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    r = ranked.withColumn("part", part).join(base, "part").withColumn("rank", F.col("base") + place)
    shard = F.expr(f"(rank * {count}) div total")
    first = F.expr(f"(((rank * {count}) div total) * total + {count - 1}) div {count}")
    return r.select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )


def write_in_curve_order(df: DataFrame, path: str, files: int, bits: int = 6, text: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> None:
    """Writes whole rows as so many files, each a run of the curve. A run is a box of a few ranges of every
    dimension, so Parquet's minima and maxima let readers skip files by any of them; the first dimensions
    are cut once more than the last where ``files`` isn't a power of two to their number."""
    sized = df.withColumn("size_", text_bytes(text) + 1)
    cells = ordered_cells(sized.select(*categories, "size_"), (*categories, "size_"), bits)
    placed = sized.withColumn("curve_index_", curve(cells, bits)).drop("size_")
    placed.repartitionByRange(files, "curve_index_").sortWithinPartitions("curve_index_").drop("curve_index_").write.parquet(path)


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir)).drop("curve_index")
