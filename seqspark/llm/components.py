"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two grouped minima and joins over fixed-size rows; stars with a huge centre are skewed
joins, which Spark splits. Nothing is gathered per node or on the driver but a count and a checksum,
which tell when a round changes nothing. Each round's links are written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that links, from columns u and v of any orderable type; the
    component is its least node. Loops, repeats and nulls in links don't matter; no links: no rows."""
    e = written(links.filter("u != v").select("u", "v").distinct(), "links")
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        state = now
        e = written(_small_star(_large_star(e).distinct()).distinct(), "links")
