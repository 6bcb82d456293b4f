"""Operator 9: similarity join of shingle sets with size-banded tiles and bitmap signatures.

1. Documents with equal shingle sets become one class, known by a 128-bit sum of their hashes.
2. Stars: classes that share one of eight minima of their sets are compared with two classes of the
   group: the one whose shingles are the most common on average (the text that edited copies come from has
   no rare shingles of its own), and one at random, another for each minimum. That links most near copies
   at a cost in proportion to their number, not to its square.
3. Tiles: a set names its first ``n - ceil(0.85 n) + 1`` shingles in a global order, rare ones first (by a
   fixed-size sketch of counts); sets that link share one of them. A tile holds the sets of one size band
   that name one shingle, and meets its own and the next band. Tiles whose classes are all in one
   component already are left out. At the first shingle that two sets share, what either has from there
   on bounds their overlap, so places too small for a link give no pair. No link between components is lost.
4. Each pair that a tile gives is held against the bound of its bitmap signatures: the parity bitmaps
   differ in at most as many bits as the sets differ in members, so their XOR bounds the overlap from above.
   Pairs that may link are decided by exact intersection of their sorted shingle arrays.
5. Components of all links, by alternating stars.

Scale: texts are read twice (counts, sets) and only texts of candidate pairs are shuffled. All keyed
steps are equi-joins and combined aggregates over fixed-size rows. The sketch is one byte for each of
2**20 buckets, whatever the input. Very long or very common passages give tiles only where they are
among a set's rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .components import components
from .hashing import mix, text_buffer, text_slices, window_hashes, words

_BUCKETS, _SEGMENTS, _MINIMA = 1 << 20, 64, 8
#: Keys of documents (8 bytes each) that may be broadcast.
FEW = 2_000_000


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle, repeats included."""
    data, ends = text_buffer(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    _, _, doc, h = words(data, ends)
    n = max(0, len(h) - size + 1)
    same = doc[:n] == doc[size - 1 :][:n] if n else np.zeros(0, bool)
    docs, hashes = [doc[:n][same]], [window_hashes(h, size)[same] if n else np.zeros(0, np.uint64)]
    count = np.bincount(doc, minlength=len(column))
    first = np.searchsorted(doc, np.arange(len(column)))
    for k in range(1, size):  # texts of fewer words: all of them as one
        few = np.flatnonzero(count == k)
        if len(few):
            docs.append(few)
            hashes.append(window_hashes(h, k)[first[few]])
    return np.concatenate(docs), np.concatenate(hashes)


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    doc, h = _shingles(column, size)
    order = np.argsort(doc, kind="stable")
    return [np.unique(x) for x in np.split(h[order], np.cumsum(np.bincount(doc, minlength=len(column)))[:-1])]


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_BUCKETS, np.int64)
        for whole in batches:
            for batch in text_slices(whole, 0):
                counts += np.bincount((_shingles(batch.column(0), size)[1] >> np.uint64(44)).astype(np.int64), minlength=_BUCKETS)
        if counts.any():
            parts = counts.astype(np.uint32).reshape(_SEGMENTS, -1)
            yield pa.RecordBatch.from_pydict({"segment": pa.array(range(_SEGMENTS), pa.int32()), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})

    return run


def _sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[k] = sums.get(k, 0) + np.frombuffer(x.as_py(), np.uint32).astype(np.int64)
    if sums:
        levels = [(2 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(sums), pa.int32()), "levels": pa.array(levels, pa.binary())})


def shingle_levels(texts: DataFrame, size: int) -> np.ndarray:
    """How common the shingles of each hash bucket are, in half powers of two: 2**20 bytes for any input."""
    rows = texts.mapInArrow(_sketch(size), "segment int, counts binary").repartition(_SEGMENTS, "segment").mapInArrow(_sketch_sum, "segment int, levels binary").collect()
    levels = np.zeros((_SEGMENTS, _BUCKETS // _SEGMENTS), np.uint8)
    for r in rows:
        levels[r.segment] = np.frombuffer(r.levels, np.uint8)
    return levels.reshape(-1)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def signature(members: np.ndarray) -> bytes:
    """Parity bitmap: the bit of each member is flipped. Half as many bits as members, or more."""
    bits = 1 << max(6, int(len(members) // 2).bit_length())
    odd = np.bincount((mix(members ^ np.uint64(0xA5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """The most members two sets with these signatures and sizes can share."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # a bit number modulo fewer bits: halves laid over each other
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


_SETS = "doc_id bigint, h bigint, n bigint, node binary, central int, minima array<bigint>, prefix array<bigint>, signature binary"


def _set_rows(size: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        odd = mix(np.arange(1, _MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
        for whole in batches:
            for batch in text_slices(whole, 2):
                out: dict[str, list] = {k: [] for k in ("n", "node", "central", "minima", "prefix", "signature")}
                for s in _sets(batch.column(2), size):
                    n = len(s)
                    out["n"].append(n)
                    if not n:
                        for k in ("node", "central", "minima", "prefix", "signature"):
                            out[k].append(None)
                        continue
                    sums = np.array([mix(s ^ np.uint64(17)).sum(dtype=np.uint64), mix(s ^ np.uint64(1 << 40)).sum(dtype=np.uint64)])
                    out["node"].append(sums.tobytes())
                    out["minima"].append([int((s * m).min().view(np.int64)) for m in odd])
                    k = prefix_size(n, percent)
                    lv = level[(s >> np.uint64(44)).astype(np.int64)]
                    out["central"].append(int(1000 * lv.mean()))
                    out["prefix"].append(s[np.lexsort((s, lv))[:k]].view(np.int64))
                    out["signature"].append(signature(s))
                kinds = {"n": pa.int64(), "node": pa.binary(), "central": pa.int32(), "minima": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64()), "signature": pa.binary()}
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", "h", *kinds])

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = [(100 + percent) * overlap_bound(*x) >= percent * (x[2] + x[3]) for x in zip(a, b, na, nb)]
            yield batch.select([0, 1, *range(6, batch.num_columns)]).filter(pa.array(keep, pa.bool_()))

    return run


def _exact(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in text_slices(whole, 2):
                for batch in text_slices(some, 3):
                    a, b = _sets(batch.column(2), size), _sets(batch.column(3), size)
                    keep = []
                    for x, y in zip(a, b):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(df: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, n_shingles, component_id, component): h is a hash of the text; the component's id is its
    least key, which components can have in common; component is its own (null without shingles).

    Null and empty texts, or texts without words, have no shingles and are components of their own; so
    has a row with a null key unless it links (its own id is then null). Rows with equal sets link,
    repeated rows too. Other columns don't take part; an empty table gives no rows."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(shingle_levels(docs.select("text"), size))
    rows = written(docs.mapInArrow(_set_rows(size, percent, levels), _SETS), "shingle-sets")
    classes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    # One row for each class: its least document's.
    same = (F.col("c.node") == F.col("s.node")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.h") == F.col("s.h"))
    reps = written(rows.alias("s").join(classes.alias("c"), same).select("s.*").dropDuplicates(["node"]), "shingle-classes")
    texts = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**62))))
    have = reps.select("node", F.coalesce("doc_id", F.lit(-(2**62))).alias("doc_id"), "h")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link. Of the texts, those of the pairs go on, each once: where the pairs
        name few documents, their keys are sent to all tasks; otherwise the joins leave the others out."""
        side = lambda c: have.select(F.col("node").alias(c), F.col("doc_id").alias(f"id_{c}"), F.col("h").alias(f"h_{c}"))
        named = written(pairs.join(side("a"), "a").join(side("b"), "b"), "jaccard-pairs")
        ids = named.select(F.explode(F.array(F.xxhash64("id_a", "h_a"), F.xxhash64("id_b", "h_b"))).alias("k")).distinct()
        some = texts
        if ids.count() <= FEW:
            some = texts.withColumn("k", F.xxhash64("doc_id", "h")).join(F.broadcast(ids), "k", "left_semi")
        some = some.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        full = named
        for c in "ab":
            full = full.join(some.select(F.col("doc_id").alias(f"id_{c}"), F.col("h").alias(f"h_{c}"), F.col("text").alias(f"text_{c}")), [f"id_{c}", f"h_{c}"])
        return full.select("a", "b", "text_a", "text_b").mapInArrow(_exact(size, percent), "a binary, b binary")

    signed = reps.select("node", "n", "signature")

    def may_link(pairs: DataFrame, *more: str) -> DataFrame:
        """Without the pairs that their signatures rule out."""
        both = pairs.join(signed.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a")), "a").join(
            signed.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b")), "b"
        )
        close = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        ddl = ", ".join(["a binary", "b binary", *(f"{c} bigint" for c in more)])
        return close.select("a", "b", "s_a", "s_b", "n_a", "n_b", *more).mapInArrow(_bounded(percent), ddl)

    # Stars.
    minima = reps.select("node", "central", F.posexplode("minima").alias("k", "m"))
    # The random leader's order is another for each minimum: where copies link with some of the others
    # only, a class then meets up to eight of them, not the same one again.
    order = F.struct(F.xxhash64("node", "k"), "node")
    best = [F.max_by("node", F.struct("central", "node")), F.max_by("node", order)]
    leaders = minima.groupBy("k", "m").agg(F.array_distinct(F.array(*best)).alias("b"), F.count("*").alias("n")).filter("n > 1")
    leaders = leaders.select("k", "m", F.explode("b").alias("b"))
    # First each class meets one leader, that with which it shares the most minima; what that links needn't be
    # compared again, so few texts move.
    stars = minima.join(leaders, ["k", "m"]).filter("node != b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    stars = written(may_link(stars, "n"), "stars")
    nearest = stars.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    links = written(linked(nearest).select(F.col("a").alias("u"), F.col("b").alias("v")), "star-links")
    found = components(links)
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    apart = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    more = linked(apart).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    # Tiles.
    placed = reps.select("node", "n", "prefix").join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("c"), "prefix")
    # A row for each named shingle; as for shingles, 64-bit hashes stand for the set and its component.
    named = placed.select(F.xxhash64("node").alias("s"), F.xxhash64("c").alias("c"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "shingle"))
    named = named.select("shingle", "s", "c", "n", (F.col("n") - F.col("at")).alias("rest"))  # members from this one on
    same = Window.partitionBy("shingle")
    tiles = named.select("*", F.min("c").over(same).alias("lo"), F.max("c").over(same).alias("hi")).filter("lo < hi").drop("lo", "hi")
    tiles = written(tiles.withColumn("band", F.floor(F.log("n") / F.log(F.lit(101 / percent))).cast("int")), "tiles")  # a little wider than the threshold
    small = tiles.select("shingle", F.explode(F.array("band", F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}_a") for c in ("s", "n", "rest", "c")])
    large = tiles.select("shingle", "band", *[F.col(c).alias(f"{c}_b") for c in ("s", "n", "rest", "c")])
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("s_a") < F.col("s_b")))
    close = (100 * F.col("n_a").cast("long") >= percent * F.col("n_b").cast("long")) & (F.col("c_a") != F.col("c_b"))
    enough = (100 + percent) * F.least("rest_a", "rest_b").cast("long") >= percent * (F.col("n_a").cast("long") + F.col("n_b"))
    pairs = small.join(large, ["shingle", "band"]).filter(ordered & close & enough).select("s_a", "s_b").distinct()
    hashed = lambda c: reps.select(F.xxhash64("node").alias(f"s_{c}"), F.col("node").alias(c))
    pairs = pairs.join(hashed("a"), "s_a").join(hashed("b"), "s_b").select("a", "b")
    more = linked(may_link(pairs)).select(F.col("a").alias("u"), F.col("b").alias("v"))

    joined = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    member = rows.select("doc_id", "h", "n", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return member.join(least, "component", "left").select(
        F.col("doc_id").alias(key), "h", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "component"
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("h", "component")
