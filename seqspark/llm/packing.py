"""Operator 2: mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. In round r each queue adds its quantum (1,024 tokens times its target
share, with a fraction) to its deficit and sends as many whole tokens as the deficit holds; the
fraction stays for later rounds. Rounds follow one another in one stream, which is cut into windows of
1,024: every window is full but the last, and holds every queue at its share until queues run out.

A queue whose quantum is below one token begins with a part of a token as its deficit, by hash of its
name, or all queues of one size would send in the same rounds.

The state of that loop has a closed form, so a token's round follows from its place in its queue, and
windows need no sequential pass: deficits carry over windows and partitions by arithmetic.

Scale: texts are encoded once, into a written table of narrow ids; a task numbers the tokens of each
source within its partition, and a small table of (partition, source) totals gives the partitions'
offsets. Documents are cut where blocks of 256 rounds end and dealt by block; a block (about 262,144
tokens) sorts its runs by round and queue, and sums of the blocks before it give its place in the stream.
Nothing is dealt by source, and neither the driver nor a task holds all queues, whatever their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .hashing import text_slices
from .tokens import MANY, ByteEncoder, encoder, id_type

WINDOW = 1024
_FRACTION = 18  # bits of a quantum's fraction
_ROUNDS = 256  # in a block
_SUPER = 4096  # blocks whose sums one row holds


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sent = encoder(ByteEncoder, path), TaskContext.get().partitionId(), {}
        end, width = np.array([end_id], encode.kind).tobytes(), encode.kind.itemsize
        for whole in batches:
            for batch in text_slices(whole, 1, MANY):
                ids = [x + end for x in encode.ids(batch.column(1))]
                sizes = [len(x) // width for x in ids]
                starts = []
                for n, queue in zip(sizes, batch.column(2).to_pylist()):
                    starts.append(sent.get(queue, 0))
                    sent[queue] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "start", "n", "ids"],
                )

    return run


def quantum(weight: float, whole: float) -> int:
    """Tokens that a queue of this weight gets a round, in units of 2**-18."""
    return max(1, weight * (WINDOW << _FRACTION) // whole if isinstance(weight, int) else int(weight / whole * (WINDOW << _FRACTION)))


def quanta(totals: list[int], targets: list[float] | None = None) -> list[int]:
    whole = sum(targets or totals) or 1
    return [quantum(t, whole) for t in targets or totals]


def rounds_of(place: np.ndarray, units: np.ndarray, rate: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """The rounds that send the tokens at these places of their queues. units: as quantum gives it; a queue
    below one token a round goes by rate (tokens a round) and begins with 1 - phase tokens."""
    whole = (((place + 1) << _FRACTION) - 1) // units
    return np.where(units >> _FRACTION, whole, np.ceil((place + phase) / rate).astype(np.int64) - 1)


def _queues(weights: list, phases: list, whole: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, rate, phase) of queues."""
    units = np.array([quantum(w, whole) for w in weights], np.int64)
    least = 0.0 if all(isinstance(w, int) for w in weights) else 1 / (1 << _FRACTION)
    return units, np.array([max(WINDOW * w / whole, least) for w in weights], float), np.array(phases, float)


def _block_sizes(whole: float, some: int = 1 << 20):
    """From stretches of queues: how many of their tokens each block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, n, weights, phases = (c.to_pylist() for c in batch.columns)
            units, rate, phase = _queues(weights, phases, whole)
            for i, (first, many) in enumerate(zip(base, n)):
                for lo in range(first, first + many, some):
                    place = np.arange(lo, min(lo + some, first + many))
                    block, count = np.unique(rounds_of(place, units[i], rate[i], phase[i]) // _ROUNDS, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(count)], names=["block", "n"])

    return run


_CHUNKS = "block bigint, doc_id bigint, doc_tokens bigint, queue string, total bigint, weight {}, phase double, place bigint, within bigint, ids binary"


def _chunks(whole: float, width: int):
    """Documents, cut where blocks end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, size, ids = batch.column(5).to_numpy(), batch.column(6).to_numpy(), batch.column(7)
            units, rate, phase = _queues(batch.column(3).to_pylist(), batch.column(4).to_pylist(), whole)
            ends = rounds_of(np.append(place, place + size - 1), np.tile(units, 2), np.tile(rate, 2), np.tile(phase, 2)) // _ROUNDS
            row, block, within, cut = [], [], [], []
            for i, (lo, hi) in enumerate(zip(ends[: len(size)].tolist(), ends[len(size) :].tolist())):
                edges, blocks, data = [0], [lo], ids[i].as_py()
                if lo < hi:
                    b = rounds_of(np.arange(place[i], place[i] + size[i]), units[i], rate[i], phase[i]) // _ROUNDS
                    edges += (np.flatnonzero(b[1:] != b[:-1]) + 1).tolist()
                    blocks = b[edges].tolist()
                row += [i] * len(edges)
                block += blocks
                within += edges
                cut += [data[width * x : width * y] for x, y in zip(edges, [*edges[1:], int(size[i])])]
            row, within = np.array(row, np.int64), np.array(within, np.int64)
            of = lambda k: batch.column(k).take(pa.array(row))
            columns = [pa.array(block, pa.int64()), of(0), of(6), of(1), of(2), of(3), of(4), pa.array(place[row] + within), pa.array(within), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CHUNKS.split(", ")])

    return run


def _pieces(whole: float, kind: np.dtype):
    """The pieces of a block."""

    def cut(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["ids"].to_pylist()
        size = np.array([len(x) // kind.itemsize for x in ids], np.int64)
        ends = np.cumsum(size)
        chunk = np.repeat(np.arange(len(size)), size)
        nth = np.arange(ends[-1]) - np.repeat(ends - size, size)
        place, within = t["place"].to_numpy(), t["within"].to_numpy()
        queues: dict[tuple, int] = {}
        queue = np.array([queues.setdefault(x, len(queues)) for x in zip(t["total"].to_pylist(), t["queue"].to_pylist(), t["weight"].to_pylist(), t["phase"].to_pylist())], np.int64)
        units, rate, phase = _queues([x[2] for x in queues], [x[3] for x in queues], whole)
        q = queue[chunk]
        rounds = rounds_of(place[chunk] + nth, units[q], rate[q], phase[q])
        # Runs of one chunk in one round, in the order of the stream: by round, queue (large ones first), place.
        new = np.ones(len(chunk), bool)
        new[1:] = (chunk[1:] != chunk[:-1]) | (rounds[1:] != rounds[:-1])
        lo = np.flatnonzero(new)
        n = np.diff(np.append(lo, len(chunk)))
        turn = np.empty(len(queues), np.int64)
        turn[[queues[x] for x in sorted(queues, key=lambda x: (-x[0], x[1]))]] = np.arange(len(queues))
        order = np.lexsort((place[chunk[lo]] + nth[lo], turn[q[lo]], rounds[lo]))
        first = np.empty(len(lo), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        at = np.repeat(first - lo, n) + np.arange(len(chunk)) + t["base"][0].as_py()
        new[1:] = (chunk[1:] != chunk[:-1]) | (at[1:] != at[:-1] + 1) | (at[1:] % WINDOW == 0)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(at))
        flat = memoryview(np.frombuffer(b"".join(ids), kind).astype("<u4").tobytes())
        crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip((lo * 4).tolist(), (hi * 4).tolist())), np.int64, len(lo))
        c = chunk[lo]
        columns = [t["doc_id"].take(pa.array(c)), within[c] + nth[lo], hi - lo, crc, t["doc_tokens"].to_numpy()[c], at[lo] // WINDOW, at[lo] % WINDOW]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut


def stream_places(queue: np.ndarray, place: np.ndarray, totals: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The place in the stream of the tokens at these places of these queues, where all have whole quanta or
    begin without a deficit: what blocks must agree with, from the totals of all queues."""
    rounds = (((place + 1) << _FRACTION) - 1) // q[queue]
    own, at = np.unique(rounds, return_inverse=True)
    sent = np.minimum(totals, (own[:, None] * q) >> _FRACTION)
    more = np.minimum(totals, ((own + 1)[:, None] * q) >> _FRACTION) - sent
    ahead = np.cumsum(more, axis=1) - more
    return sent.sum(axis=1)[at] + ahead[at, queue] + place - sent[at, queue]


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty (its document is the end id alone); null sources form a queue of their own;
    repeated rows and keys are documents of their own, a null key stays null; other columns don't take
    part. An empty table gives no pieces. ``targets`` maps sources to shares of tokens (all sources that
    the table holds, None for null ones; a share must be above zero); without it the shares are the table's own and all queues end together."""
    queue = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), queue.alias("queue"))
    kind = id_type(tokenizer_path)
    ids = written(docs.mapInArrow(_tokenised(tokenizer_path, end_id), "doc_id bigint, queue string, part int, start bigint, n bigint, ids binary"), "packing-ids")
    by_part = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    sums = by_part.groupBy("queue").agg(F.sum("n").alias("total"))
    if targets and not all(v > 0 for v in targets.values()):
        raise ValueError("a target share must be above zero: its queue would never end")
    if targets:
        shares = df.sparkSession.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in targets.items()], "queue string, weight double")
        sums = sums.join(shares, "queue", "left")
        missing = sums.filter("weight is null").first()
        if missing:
            raise KeyError(f"no target for {missing.queue}")
    else:
        sums = sums.withColumn("weight", F.col("total"))
    sums = sums.withColumn("phase", (F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20)))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = written(offsets.join(sums, "queue"), "packing-offsets")  # as a file, its size tells whether it's broadcast
    whole = base.filter("base = 0").agg(F.sum("weight")).first()[0] or 1
    sizes = base.select("base", "n", "weight", "phase").mapInArrow(_block_sizes(whole), "block bigint, n bigint").groupBy("block").agg(F.sum("n").alias("n"))
    sizes = written(sizes.withColumn("super", F.floor(F.col("block") / _SUPER)), "packing-blocks")
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    supers = sizes.groupBy("super").agg(F.sum("n").alias("n")).select("super", ahead(Window.orderBy("super")).alias("base"))
    blocks = sizes.withColumn("inner", ahead(Window.partitionBy("super").orderBy("block"))).join(supers, "super")
    blocks = written(blocks.select("block", (F.col("inner") + F.col("base")).alias("base")), "packing-bases")
    placed = ids.join(base.drop("n"), ["part", "queue"]).select("doc_id", "queue", "total", "weight", "phase", (F.col("base") + F.col("start")).alias("start"), "n", "ids")
    chunks = placed.mapInArrow(_chunks(whole, kind.itemsize), _CHUNKS.format("double" if targets else "bigint"))
    return chunks.join(blocks, "block").groupBy("block").applyInArrow(
        _pieces(whole, kind),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(documents(spark, sf_dir), P.path("byte_bpe_50k.json"))
