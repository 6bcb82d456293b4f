"""Operator 11: ranked lexical search by Block-Max MaxScore.

A first pass over the texts counts, for each document, its terms and the occurrences of the terms that some
query asks for; from these rows come the statistics of the whole table. A second pass, over these rows, puts
documents into shards. A shard has for each term a list of compressed blocks of postings, with the greatest
share of a score that a list and each of its blocks hold. A query's lists are ordered by that bound. Those
that together can't lift a document to the query's k-th best score known are non-essential: only essential
lists are traversed. A document found there is probed in the others, best bound first, while it can still
compete; block maxima reject it before a block is decompressed. Each task keeps a heap for each query over
its shards, and one window merges the heaps.

Scale: texts are read once for each block of queries and never shuffled; a shard, a heap and a block of
queries are bounded, so tasks are, whatever the table's size or a term's frequency. The driver and the tasks
hold one block of queries at a time (``BLOCK_TERMS``), and the number of documents that hold its terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .hashing import text_buffer, text_slices

#: Terms of a block of queries, counted with repeats (a longer query is a block of its own); documents of a shard; postings of a block.
BLOCK_TERMS, SHARD, BLOCK = 1 << 18, 8192, 128
_PIECE = 1 << 22
#: Bytes of terms, with A-Z lower-cased; all others become spaces.
_TERMS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Term -> occurrences. Terms are runs of ASCII letters and digits and of all other non-ASCII characters."""
    text, found, at = text.translate(_TERMS), Counter(), 0
    while at < len(text):  # a very long text in pieces
        end = text.find(b" ", at + _PIECE) if len(text) - at > _PIECE else len(text)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def _counted(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                data, ends = text_buffer(batch.column(1))
                ids, n, terms, times, cuts = [], [], [], [], [0]
                for row, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                    found = term_counts(data[a:b].tobytes())
                    if found:
                        ids.append(row)
                        n.append(sum(found.values()))
                        for term in found.keys() & numbers.keys():
                            terms.append(numbers[term])
                            times.append(found[term])
                        cuts.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())))


class Postings:
    """A term's list in a shard: blocks of document places (as gaps) and occurrences, each in the fewest bytes."""

    def __init__(self, places: np.ndarray, times: np.ndarray, parts: np.ndarray):
        cuts = np.arange(0, len(places), BLOCK)
        self.best = np.maximum.reduceat(parts, cuts)
        self.first, self.last = places[cuts], places[np.append(cuts[1:], len(places)) - 1]
        self.top = int(self.best.max())
        gaps = np.diff(places, prepend=0)
        gaps[cuts] = 0
        self.blocks = [(_narrow(gaps[a : a + BLOCK]), _narrow(times[a : a + BLOCK])) for a in cuts.tolist()]

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        gaps, times = self.blocks[block]
        return np.cumsum(gaps, dtype=np.int64) + self.first[block], times.astype(np.int64)


def part(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


class Shard:
    def __init__(self, n: np.ndarray, places: np.ndarray, terms: np.ndarray, times: np.ndarray, documents: int, length: int):
        self.m = 75 + (25 * n * documents) // length
        order = np.lexsort((places, terms))
        places, terms, times = places[order], terms[order], times[order]
        parts = part(times, self.m[places])
        edges = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        self.lists = {int(terms[a]): Postings(places[a:b], times[a:b], parts[a:b]) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(terms)])}

    def _add(self, score: np.ndarray, weight: int, found: Postings, blocks) -> None:
        """Adds what blocks of a list hold to the scores by place."""
        for b in blocks:
            places, times = found.read(b)
            score[places] += weight * part(times, self.m[places])

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        """The k-th best score so far: scores only rise, so the final one is no less."""
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0

    def search(self, weights: dict[int, int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that can be among the k best of the query and score ``least`` or more."""
        lists = sorted(((w * self.lists[t].top, t, w, self.lists[t]) for t, w in weights.items() if w > 0 and t in self.lists), key=lambda x: (-x[0], x[1]))
        left = np.append(np.cumsum([x[0] for x in lists][::-1], dtype=np.int64)[::-1], 0)  # bounds of a list and all after it
        score, alive, at = np.zeros(len(self.m), np.int64), np.zeros(0, np.int64), 0
        while at < len(lists) and left[at] >= least:  # essential: unmet documents can still compete
            _, _, w, found = lists[at]
            self._add(score, w, found, range(len(found.blocks)))
            alive, at = np.flatnonzero(score), at + 1
            least = max(least, self._kth(score[alive], k))
        for j in range(at, len(lists)):  # non-essential
            _, _, w, found = lists[j]
            alive = alive[score[alive] + left[j] >= least]
            block = np.searchsorted(found.last, alive)
            inside = block < len(found.blocks)
            inside[inside] = alive[inside] >= found.first[block[inside]]
            most = np.zeros(len(alive), np.int64)
            most[inside] = w * found.best[block[inside]]
            fits = score[alive] + most + left[j + 1] >= least
            alive, block = alive[fits], block[fits & inside]
            self._add(score, w, found, np.unique(block).tolist())
            least = max(least, self._kth(score[alive], k))
        alive = alive[score[alive] >= max(least, 1)]
        return alive, score[alive]


def _searcher(queries: list[tuple[int, dict[int, int]]], k: int, documents: int, length: int):
    """Heaps of all queries over the documents of a task, shard after shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        heaps = [(none, none, np.zeros(0, bool))] * len(queries)

        def take(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks().sort_by([("doc_id", "ascending")])  # nulls are last
            lists = t["terms"].combine_chunks()
            places = np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy())
            shard = Shard(t["n"].to_numpy(), places, lists.flatten().to_numpy(), t["times"].combine_chunks().flatten().to_numpy().astype(np.int64), documents, length)
            ids, no_id = t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_null().to_numpy()
            for q, (_, weights) in enumerate(queries):
                scores, own, null = heaps[q]
                found, score = shard.search(weights, k, int(scores[-1]) if len(scores) == k else 1)
                if len(found):
                    scores, own, null = np.append(scores, score), np.append(own, ids[found]), np.append(null, no_id[found])
                    best = np.lexsort((own, null, -scores))[:k]
                    heaps[q] = scores[best], own[best], null[best]

        parts, rows = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD):
                parts.append(whole.slice(at, SHARD))
                rows += parts[-1].num_rows
                if rows >= SHARD:
                    take(parts)
                    parts, rows = [], 0
        if parts:
            take(parts)
        for (q, _), (scores, own, null) in zip(queries, heaps):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q)), pa.array(own, mask=null), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[Row, Counter]]]:
    """Items with terms, some at a time."""
    block, size = [], 0
    for item in items.toLocalIterator():
        found = term_counts((item.text or "").encode())
        if block and size + sum(found.values()) > most:
            yield block
            block, size = [], 0
        if found:
            block.append((item, found))
            size += sum(found.values())
    if block:
        yield block


def search(df: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, key, score): the k documents that score highest for each row of items, in 64-bit integers;
    ties go to the smaller key, null keys last. Every row is a document or an item of its own. Null texts have
    no terms; items without terms, or whose terms no document holds, have no rows, nor have empty tables."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    done = None
    for block in _blocks(items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")), block_terms):
        numbers = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        counted = written(docs.mapInArrow(_counted(numbers), "doc_id bigint, n bigint, terms array<int>, times array<int>"), "postings")
        total, length, longest = counted.agg(F.count("*"), F.sum("n"), F.max("n")).first()
        if not total:
            break
        if 25 * longest * total >= 2**63:
            raise OverflowError("a document's length doesn't fit the score's 64 bits")
        held = {r.t: r.n for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row for each term of the block
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in held.items()}
        queries = [(q, {numbers[t]: times * weight[numbers[t]] for t, times in found.items() if numbers[t] in weight}) for q, (_, found) in enumerate(block)]
        heaps = counted.mapInArrow(_searcher(queries, k, total, length), "q bigint, doc_id bigint, score bigint")
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = df.sparkSession.createDataFrame([(q, r.item) for q, (r, _) in enumerate(block)], "q bigint, item bigint")
        part_of = ranked.join(names, "q").select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")
        done = written(part_of, "found") if done is None else done.unionByName(written(part_of, "found"))
    return df.sparkSession.createDataFrame([], f"{item} bigint, rank int, {key} bigint, score bigint") if done is None else done


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
