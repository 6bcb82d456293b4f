"""The k-mer index: energies of motifs by k-mer, averaged over geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEMPERATURE = 1.0


def index_long(rows: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(seq, idx, count, buckets, mean, std) from (seq, geom, row array<double>).

    Rows of one k-mer and geometry are a bucket with a mean and population deviation. A k-mer's mean is
    -T log of the mean of exp(-m/T) over its rows' buckets (shifted by the least, so it can't overflow); its
    variance is within buckets and between. Sums combine before the shuffle; no list of rows is kept."""
    cells = rows.select("seq", "geom", F.posexplode("row").alias("idx", "e"))
    sums = cells.groupBy("seq", "idx", "geom").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"), F.count("*").alias("n"))
    m = F.col("s") / F.col("n")
    buckets = sums.select("seq", "idx", "n", m.alias("m"), F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)).alias("v"))
    least = F.min("m").over(Window.partitionBy("seq", "idx"))
    n = F.sum("n")
    part = buckets.withColumn("low", least).groupBy("seq", "idx").agg(
        n.alias("count"), F.count("*").alias("buckets"), F.min("low").alias("low"),
        (F.sum(F.col("n") * F.exp(-(F.col("m") - F.col("low")) / temperature)) / n).alias("x"),
        (F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n).alias("q"), (F.sum(F.col("n") * F.col("m")) / n).alias("a"), F.min("v").alias("v"),
    )
    one = F.col("buckets") == 1
    mean = F.when(one, F.col("low")).otherwise(F.col("low") - temperature * F.log("x"))
    with_mean = part.withColumn("mean", mean)
    var = F.col("q") - 2 * F.col("mean") * F.col("a") + F.col("mean") * F.col("mean")
    return with_mean.select("seq", "idx", "count", "buckets", "mean", F.sqrt(F.greatest(F.when(one, F.col("v")).otherwise(var), F.lit(0.0))).alias("std"))


def index_arrays(long: DataFrame) -> DataFrame:
    """(seq, count, buckets, mean, std) with arrays in the alphabet's order: 20 values a k-mer."""
    packed = long.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("idx", "mean", "std"))).alias("r"), F.first("count").alias("count"), F.first("buckets").alias("buckets"))
    return packed.select("seq", "count", "buckets", F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["std"]).alias("std"))


def build_index(rows: DataFrame) -> DataFrame:
    return index_arrays(index_long(rows))


def reciprocal_pairs(index_1x1: DataFrame, mode: str = "sum") -> DataFrame:
    """(source, target, forward, reverse, value, std): each residue pair both ways, from the long 1x1 index."""
    from ..functions import alphabet as A

    residue = F.substring(F.lit(A.ALPHABET), F.col("idx") + 1, F.lit(1))
    a = index_1x1.select(F.col("seq").alias("source"), residue.alias("target"), F.col("mean").alias("forward"), F.col("std").alias("s1"))
    b = index_1x1.select(F.col("seq").alias("target"), residue.alias("source"), F.col("mean").alias("reverse"), F.col("std").alias("s2"))
    half = {"sum": 1, "mean": 2}[mode]
    return a.join(b, ["source", "target"]).select(
        "source", "target", "forward", "reverse", ((F.col("forward") + F.col("reverse")) / half).alias("value"), (F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) / half).alias("std")
    )


def reciprocal_matrix(pairs: DataFrame, order: str) -> DataFrame:
    """A row per source, a column per target, in this order."""
    wide = pairs.groupBy("source").pivot("target", list(order)).agg(F.first("value"))
    return wide.orderBy(F.instr(F.lit(order), F.col("source")))


def reciprocal_index(index_1x1: DataFrame, mode: str) -> DataFrame:
    """The 1x1 index in a mode: directed, reciprocal_sum or reciprocal_mean. Counts are the source's."""
    if mode == "directed":
        return index_1x1
    if mode not in ("reciprocal_sum", "reciprocal_mean"):
        raise ValueError(f"unknown 1x1 mode {mode!r}")
    from ..functions import alphabet as A

    pairs = reciprocal_pairs(index_1x1, mode.removeprefix("reciprocal_"))
    counts = index_1x1.groupBy("seq").agg(F.first("count").alias("count"), F.first("buckets").alias("buckets"))
    return pairs.join(counts, pairs.source == counts.seq).select("seq", A.index_of(F.col("target")).alias("idx"), "count", "buckets", F.col("value").alias("mean"), "std")
