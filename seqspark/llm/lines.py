"""Operator 12: removal of lines that many documents hold, in DataFrame functions alone.

Each long line becomes a 128-bit hash of its key with its document and position; texts don't travel with
them. The hashes are range-partitioned and sorted by hash, then document (largest id first), then position,
so that a key's lines stream past in order: its first document keeps them, the later ones lose theirs. What
goes back to a document is a bitmap of the lines to keep, with the 64-line words that keep all left out.

Scale: hashes are shuffled once by range; a key with more than a thousandth of all lines would fill a
partition, so such keys (a thousand at most, found by counts combined before their shuffle) have their
documents counted apart, are broadcast and have their lines dealt out by document. Bitmaps meet texts in
one join on the document, which Spark broadcasts where they are few and splits where a document is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot from this share of all lines on (and this many lines): there can't be more than 1,000.
HOT_SHARE, HOT_LINES = 1000, 4096


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, lines): h is a hash of the text; with the id it names the document."""
    return df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))


def line_hashes(df: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2, doc_id, h, pos) of each line whose key has ``least`` code points or more."""
    line = _keyed(df, key, text).select("doc_id", "h", F.posexplode("lines").alias("pos", "line"))
    line = line.filter(F.octet_length("line") >= least).withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= least)
    low = F.when(F.octet_length("line") == F.char_length("line"), F.lower("line")).otherwise(F.translate("line", _UPPER, _LOWER))
    return line.select("doc_id", "h", "pos", low.alias("line")).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "h", "pos")


def _hot(lines: DataFrame, share: int, most: int) -> DataFrame:
    """(h1, h2, n, keep) of the hot keys: their documents' number and largest id."""
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    bound = max(lines.count() // share, most)
    hot = F.broadcast(written(counts.filter(F.col("n") > bound).select("h1", "h2"), "hot-lines"))  # fewer than `share` rows
    held = lines.join(hot, ["h1", "h2"]).groupBy("h1", "h2", "doc_id", "h").agg(F.lit(1).alias("one"))
    return held.groupBy("h1", "h2").agg(F.count("*").alias("hot_n"), F.max("doc_id").alias("hot_keep"))


def keep_bitmaps(df: DataFrame, least: int = 40, documents: int = 5, key: str = "doc_id", text: str = "text", hot_share: int = HOT_SHARE, hot_lines: int = HOT_LINES) -> DataFrame:
    """(doc_id, h, n_dropped, keep) of the documents that lose lines. keep: structs (word, bits) of the
    words of 64 lines that lose some; bit i is set if line 64 * word + i stays; other words keep all.

    Lines with a key of ``least`` code points or more that ``documents`` documents hold go, but in the
    largest id that holds it. Rows equal in id and text are one document; null ids are below all others
    (if only such documents hold a key, all keep it). Empty tables give no rows."""
    lines = written(line_hashes(df, least, key, text), "lines")
    marked = lines.join(F.broadcast(_hot(lines, hot_share, hot_lines)), ["h1", "h2"], "left")
    # A hot key's lines are decided already, so they may go anywhere.
    marked = marked.withColumn("place", F.when(F.col("hot_n").isNotNull(), F.xxhash64("doc_id", "h", "pos")).otherwise(F.col("h1")))
    group, latest = ["place", "h1", "h2"], F.col("doc_id").desc_nulls_last()
    streamed = marked.repartitionByRange(*group).sortWithinPartitions(*group, latest, "h", "pos")
    order = Window.partitionBy(*group).orderBy(latest, "h")
    seen = streamed.withColumn("keep", F.first("doc_id").over(order)).withColumn("nth", F.dense_rank().over(order))
    seen = seen.withColumn("n", F.max("nth").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    n, keep = F.coalesce("hot_n", "n"), F.when(F.col("hot_n").isNotNull(), F.col("hot_keep")).otherwise(F.col("keep"))
    gone = seen.filter((n >= documents) & ~F.col("doc_id").eqNullSafe(keep))
    words = gone.groupBy("doc_id", "h", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return words.groupBy("doc_id", "h").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")
    )


def dropped_positions(keep: str) -> F.Column:
    """The positions, in order, that a bitmap drops."""
    of = lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(w["bits"], i) == 0, w["word"] * 64 + i)), lambda x: x.isNotNull())
    return F.flatten(F.transform(keep, of))


def drop_lines(df: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept) of every row of df: its kept lines joined by \\n. A null or empty
    text is one empty line."""
    docs, b = _keyed(df, key, text), bitmaps.withColumnRenamed("doc_id", "b_id").withColumnRenamed("h", "b_h")
    met = docs.join(b, docs.doc_id.eqNullSafe(b.b_id) & (docs.h == b.b_h), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dropped_positions("keep"))
    kept = F.when(F.col("keep").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return met.select(F.col("doc_id").alias(key), F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return drop_lines(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
