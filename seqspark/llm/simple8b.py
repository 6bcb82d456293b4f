"""Operator 3: token ids in word-aligned files (Simple-8b).

The file format: Parquet files whose rows are blocks of consecutive documents. A block holds 64-bit
words; the upper 4 bits of a word are its selector, which says how many ids share the other 60 bits and
how wide each is (one to sixty ids). Selector 0 is an escape: the word's lower bits number an entry in
the block's list of plain 64-bit values, for values over 60 bits. Each document starts at a word, and
the block lists the documents' first words and ids, so a reader decodes one document or a whole block
without a scan; all words of one selector are decoded at once.

Scale: one range shuffle of the texts by document id orders the files; encoding, block making and
decoding stream within tasks, and a block is bounded (``block_ids`` ids, or one document). Only the
totals of partitions meet in one place and are sent to all tasks, so blocks are read where their files
are, a row group of some MB at a time. Long documents are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .hashing import text_slices
from .tokens import MANY, WordEncoder, encoder

#: Of a row group: what the writer gathers, and what Spark's reader takes at once. A hundred blocks at least.
_GROUP_BYTES = 8 << 20
#: Ids in a word of each selector from 1, most first, and the bits of each.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_JUMPS = np.maximum(COUNTS, 1)  # an escape is one id


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 61 for those that no word holds beside a selector."""
    if not len(ids) or ids.max() < len(_WIDTHS):
        return _WIDTHS[ids]
    return np.where(ids >> np.uint64(60) > 0, 61, np.frexp(ids.astype(np.float64))[1]).astype(np.int8)  # a float may round up to the next power: one bit wider, still right


_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def pack_block(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each document, escaped values, escaped values of each document) of the ids of
    some documents, which all go through each step together."""
    sizes = np.array([len(x) for x in docs], np.int64)
    # Zeros behind each document, as many as a word may hold, keep what one word sees within it.
    gap = np.zeros(60, np.uint64)
    ids = np.concatenate([np.asarray(y, np.uint64) for x in docs for y in (x, gap)] or [gap])
    stops = np.cumsum(sizes + 60) - 60
    width = _width(ids)
    # The widest id within the next c, for the counts in ascending order: each from the one before.
    best = np.zeros(len(ids), np.int8)
    reach, widest = 1, width
    for s in range(14, 0, -1):
        while reach < COUNTS[s]:
            step = min(reach, COUNTS[s] - reach)
            wider = widest.copy()
            np.maximum(widest[:-step], widest[step:], out=wider[:-step])
            widest, reach = wider, reach + step
        np.copyto(best, s, where=widest <= BITS[s])
    jump = (np.arange(len(ids)) + _JUMPS[best]).tolist()
    starts = []
    for i, stop in zip((stops - sizes).tolist(), stops.tolist()):
        while i < stop:
            starts.append(i)
            i = jump[i]
    at = np.array(starts, np.int64)
    sel, doc = best[at].astype(np.int64), np.searchsorted(stops, at, side="right")
    words = sel.astype(np.uint64) << np.uint64(60)
    escaped = np.bincount(doc[sel == 0], minlength=len(docs))
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            words[rows] |= (np.arange(len(rows)) - (np.cumsum(escaped) - escaped)[doc[rows]]).astype(np.uint64)
            continue
        part = np.zeros(len(rows), np.uint64)
        for k in range(COUNTS[s]):
            part |= ids[at[rows] + k] << np.uint64(k * BITS[s])
        words[rows] |= part
    return words, np.bincount(doc, minlength=len(docs)), ids[at[sel == 0]], escaped


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of one document's ids."""
    words, _, escapes, _ = pack_block([ids])
    return words, escapes


def unpack_words(words: np.ndarray, first_words: np.ndarray, sizes: np.ndarray, escapes: np.ndarray, first_escapes: np.ndarray) -> np.ndarray:
    """The ids of a block's documents, one after the other. All words of a selector are taken at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(sel == 0, 1, COUNTS[sel])
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = ends - count
    doc = np.repeat(np.arange(len(sizes)), np.diff(np.append(first_words, len(words))))
    low = words & np.uint64((1 << 60) - 1)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[at[rows]] = escapes[low[rows].astype(np.int64) + first_escapes[doc[rows]]]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            out[at[rows] + k] = low[rows] >> np.uint64(k * BITS[s]) & mask
    if not len(words):
        return out
    begin = np.append(at, ends[-1])[first_words]  # a document's last word may hold padding behind its ids
    keep = np.arange(len(out)) - np.repeat(begin, np.diff(np.append(begin, len(out)))) < np.repeat(sizes, np.diff(np.append(begin, len(out))))
    return out[keep]


_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    + [("first_words", pa.list_(pa.int64())), ("first_escapes", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary())]
)
_BLOCK_DDL = "part int, block int, start bigint, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, first_words array<bigint>, first_escapes array<bigint>, words binary, escapes binary"


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(WordEncoder, path), TaskContext.get().partitionId()
        end = np.array([end_id], encode.kind).tobytes()
        block, start = 0, 0
        keys: list = []
        docs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            sizes = [len(x) for x in docs]
            words, nw, escapes, ne = pack_block(docs)
            row = {
                "part": part, "block": block, "start": start, "n_ids": sum(sizes), "doc_ids": keys, "sizes": sizes,
                "first_words": (np.cumsum(nw) - nw).tolist(), "first_escapes": (np.cumsum(ne) - ne).tolist(),
                "words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        n = 0
        for whole in batches:
            for batch in text_slices(whole, 1, MANY):
                for key, data in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1))):
                    keys.append(key)
                    docs.append(np.frombuffer(data + end, encode.kind))
                    n += len(docs[-1])
                    if n >= block_ids:
                        yield out()
                        block, start, n = block + 1, start + n, 0
                        keys.clear()
                        docs.clear()
        if docs:
            yield out()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time: a batch may hold a whole file
            [r] = batch.slice(i, 1).to_pylist()
            sizes = np.array(r["sizes"], np.int64)
            ids = unpack_words(np.frombuffer(r["words"], "<u8"), np.array(r["first_words"], np.int64), sizes, np.frombuffer(r["escapes"], "<u8"), np.array(r["first_escapes"], np.int64))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "start": pa.array(ends - sizes + r["start"] + r["base"], pa.int64()),
                    "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - sizes, ends)], pa.binary()),
                }
            )


def write_ids(df: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block_ids: int = 1 << 16) -> DataFrame:
    """Writes the ids of all texts, each with the end id, in ascending key order (null keys first; equal
    keys by a hash of the text); returns the table of blocks. A null text is empty: its end id alone."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    blocks = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(tokenizer_path, end_id, block_ids), _BLOCK_DDL)
    return written(blocks, "simple8b", **{"parquet.block.size": _GROUP_BYTES})


def read_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit integers) from the files; start counts the
    ids of all documents before it. No blocks: no rows."""
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(base), "part").select(*_BLOCK.names, "base").mapInArrow(_read, "doc_id bigint, start bigint, ids binary")


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    back = read_ids(write_ids(documents(spark, sf_dir), P.path("word_bpe_49k.json")))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
