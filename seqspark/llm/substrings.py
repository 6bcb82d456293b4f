"""Operator 5: removal of repeated token windows.

Rabin-Karp hashes (128 bits) of every window of 35 words are counted in Spark, and windows that occur
more than once merge into maximal intervals of words, which are removed. Shuffling a hash for every word
of the corpus would move several times its size, so windows that can't repeat are left out first, which
loses none: each window names an anchor, the 12 words in it of least hash. Equal windows have equal
anchors, so a window whose anchor stands at one place only occurs once. About one place in twelve is an
anchor; only windows with a repeated anchor go on to be counted exactly. Of texts that stand in several
rows, all windows repeat, which needs no counting: one of the rows sends its windows for other texts to
meet, and none gets places back.

Scale: texts are shuffled once, by row key; all other shuffles hold fixed-size rows, but for the places
of a window that repeats within its document, which share a row. Anchors and windows are each shuffled once,
and counted and kept in the same pass; the rows of a hot one stream through a task, on disk where they are
many. The only gathered groups are a document's own anchors and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .hashing import sliding_min, text_buffer, text_slices, window_hashes, words

_ANCHOR = 12
_SECOND_BASE = 0x9FB21C651E98DF25


class _Windows:
    """Windows of a column of texts: the word each begins with, its document, its anchor's hash and place."""

    def __init__(self, column: pa.Array, size: int):
        self.data, self.ends = text_buffer(column)
        self.starts, self.stops, self.doc, self.h = words(self.data, self.ends)
        self.first = np.searchsorted(self.doc, np.arange(len(column) + 1))  # each document's first word
        n = max(0, len(self.h) - size + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :][:n]) if n else np.zeros(0, np.int64)
        self.size = size

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = window_hashes(self.h, _ANCHOR)
        place = np.arange(len(g), dtype=np.uint64)
        bits = np.uint64(32)  # a column has fewer words, for it has fewer bytes; the leftmost of equals is the least
        low = sliding_min((g >> bits << bits) | place, self.size - _ANCHOR + 1)[self.at]
        where = (low & np.uint64((1 << 32) - 1)).astype(np.int64)
        return g[where], where


def _anchor_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 2):
                w = _Windows(batch.column(2), size)
                hashes, where = w.anchors()
                if not len(where):
                    continue
                doc = w.doc[w.at]
                new = np.append(True, (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]))
                hashes, doc = hashes[new], doc[new]
                # One row for each anchor of a document, and whether it stands there more than once.
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
                twice = np.diff(np.append(first, len(hashes))) > 1
                rows = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[first].view(np.int64)), pa.array(twice), batch.column(0).take(rows), batch.column(1).take(rows)],
                    names=["anchor", "twice", "doc_id", "h"],
                )

    return run


def _window_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 2):
                w = _Windows(batch.column(2), size)
                hashes, _ = w.anchors()
                if not len(hashes):
                    continue
                lists = batch.column(3)
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
                doc = w.doc[w.at]
                wanted = np.zeros(len(hashes), bool)
                bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                for i in range(batch.num_rows):
                    a, b = bounds[i], bounds[i + 1]
                    wanted[a:b] = np.isin(hashes[a:b], flat[offsets[i] : offsets[i + 1]])
                at = w.at[wanted]
                one, two = window_hashes(w.h, size)[at], window_hashes(w.h, size, _SECOND_BASE)[at]
                # One row for each window of a document: its first place, and the others if it has any.
                order = np.lexsort((at, two, one, w.doc[at]))
                at, one, two = at[order], one[order], two[order]
                doc = w.doc[at]
                new = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(np.append(True, new)[: len(at)])
                copied = np.array(batch.column(4).to_pylist(), bool)[doc]
                place = np.where(copied, -1, at - w.first[doc]).astype(np.int32)
                count = np.diff(np.append(first, len(at)))
                others = np.ones(len(at), bool)
                others[first] = False
                cuts = pa.array(np.append(0, np.cumsum(count - 1)).astype(np.int32), mask=np.append(count == 1, False))  # a null cut: a null list
                more = pa.ListArray.from_arrays(cuts, pa.array(place[others]))
                rows = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[first]), more],
                    names=["w1", "w2", "doc_id", "h", "place", "more"],
                )

    return run


def _cleaner(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 2):
                data, ends = text_buffer(batch.column(2))
                starts, stops, doc, _ = words(data, ends)
                first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                copied = batch.column(4).fill_null(False)
                raw, out = data.tobytes(), {k: [] for k in ("n_words", "removed", "spans", "kept")}
                for i, places in enumerate(batch.column(3)):
                    n = int(first[i + 1] - first[i])
                    s, e = starts[first[i] : first[i + 1]], stops[first[i] : first[i + 1]]
                    keep, spans = np.ones(n, bool), []
                    if copied[i].as_py():
                        spans = [(0, n)] if n >= size else []
                        keep[:] = n < size
                    elif places.is_valid:
                        at = np.sort(np.array(places.values.to_numpy()))
                        breaks = np.flatnonzero(np.diff(at) > size)  # windows that overlap or touch are one interval
                        spans = list(zip(at[np.append(0, breaks + 1)].tolist(), (at[np.append(breaks, len(at) - 1)] + size).tolist()))
                        for a, b in spans:
                            keep[a:b] = False
                    out["n_words"].append(n)
                    out["removed"].append(int(n - keep.sum()))
                    out["spans"].append([{"first": a, "end": b} for a, b in spans])
                    out["kept"].append(b" ".join(raw[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist())).decode())
                kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out["n_words"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["spans"], kind), pa.array(out["kept"], pa.string())],
                    names=["doc_id", "h", "n_words", "n_removed", "spans", "kept"],
                )

    return run


def row_hash(key: str, text: str) -> Column:
    """A hash of the text whose lowest bit says whether the key is null; with the key it names a row."""
    return F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(key).isNull().cast("long"))


def remove_repeats(df: DataFrame, size: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, n_words, n_removed, spans, kept): removed spans as word numbers, and the kept words joined
    by one space. A document is a row; rows equal in key and text are documents of their own that repeat
    each other; a null text has no words; a null key stays null; other columns don't take part; h is
    ``row_hash``. An empty table gives no rows. Windows never cross documents, and are judged on the
    input, not on what is left."""
    # Keys may be null or repeat, so rows are told apart by key and hash of the text.
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"), row_hash(key, text).alias("h"), F.col(text).alias("text"))
    slim = docs.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2"))
    # A row for each text: the first row that has it, and whether others do.
    texts = slim.groupBy("h", "h2").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("copied"))
    copies = slim.join(texts.filter("copied").select("h", "h2"), ["h", "h2"]).select("doc_id", "h").distinct()
    docs = docs.repartition("doc_id", "h")
    anchors = docs.select("doc_id", "h", "text").mapInArrow(_anchor_rows(size), "anchor bigint, twice boolean, doc_id bigint, h bigint")
    # Windows (of rows, in Spark's sense): one shuffle, where a count and a join would take two.
    same = Window.partitionBy("anchor")
    again = anchors.select("doc_id", "h", "anchor", F.min("h").over(same).alias("lo"), F.max("h").over(same).alias("hi"), F.max("twice").over(same).alias("twice")).filter("lo < hi or twice")
    lists = again.groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("anchors"))
    lists = lists.join(texts.select("doc_id", "h", "copied"), ["doc_id", "h"])
    windows = docs.join(lists, ["doc_id", "h"]).select("doc_id", "h", "text", "anchors", "copied").mapInArrow(_window_rows(size), "w1 bigint, w2 bigint, doc_id bigint, h bigint, place int, more array<int>")
    times = F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)
    counted = windows.withColumn("n", F.sum(times).over(Window.partitionBy("w1", "w2"))).filter("n > 1 and place >= 0")
    places = counted.groupBy("doc_id", "h").agg(F.concat(F.collect_list("place"), F.flatten(F.collect_list("more"))).alias("places"))
    found = places.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True)
    out = docs.join(found, ["doc_id", "h"], "left").select("doc_id", "h", "text", "places", "copied")
    done = out.mapInArrow(_cleaner(size), "doc_id bigint, h bigint, n_words bigint, n_removed bigint, spans array<struct<first:int,end:int>>, kept string")
    return done.withColumn("doc_id", F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, F.col("doc_id"))).withColumnRenamed("doc_id", key)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
