"""Operator 1: byte-level BPE encoding and decoding.

Encoding is one ``mapInArrow``. A task cuts some MB of text into runs, of which Arrow tells the distinct ones;
their words are cut by the tokenizer's pattern, and each distinct word is folded once: numpy merges the leftmost
pair of the lowest rank of all words at a time, until no word has a pair. Ids are gathered in the documents' order.

With ``common``, words are counted first over all texts (tasks send their distinct words), and those that most
tasks meet are folded once and sent to all tasks. To look a word up costs about what it costs to fold it, so
the default is to leave that pass out.

Decoding concatenates the binary pieces of the ids.

Scale: all is row-local, so it grows with the bytes of text and a lost task redoes its own split only. A task
holds some MB of texts and a bounded number of distinct words. The vocabulary's size doesn't depend on the data.
The fold of a word of n bytes takes up to n steps of n places, which is nothing for words; one unbroken run of
over 128 bytes is merged with a heap instead.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .hashing import text_buffer, text_slices
from .tokens import MANY, SPACED, SPACED_RUNS, Runs, all_cut_at_spaces, cut_at_spaces, joined

_BITS = 18  # of an id, and of a rank
_NONE = 1 << _BITS
_SPREAD = 2_654_435_761
#: Bytes of a word that is folded with others; longer ones are merged with a heap, in n log n steps.
LONGEST = 128
#: Distinct words that a task remembers before it starts anew, and common ones that a task folds.
KEPT_WORDS, _SOME_WORDS = 300_000, 20_000
#: Words whose ids it knows, from the vocabulary or the common words, that a task remembers before it looks anew.
KEPT_SETTLED = 150_000
#: Bytes of the words that are folded once for all tasks: a bound on what is broadcast. Ids take four bytes
#: for a byte of a word at most, so that is 80 MB at most, and some 30 MB for a million ordinary words.
COMMON_BYTES = 16 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) as one number -> rank of the joined piece. A piece has one pair at most: while its
    bytes are merged, nothing reaches over their ends until they are one piece, so they go through the states
    that they go through alone, of which one has two pieces."""
    if max(ranks.values(), default=0) + 1 >= 1 << _BITS:
        raise ValueError(f"ids must be below 2**{_BITS}")
    out = {}
    for piece, rank in list(ranks.items()):
        if len(piece) > 1:
            del ranks[piece]
            two = merge_long(piece, ranks)
            ranks[piece] = rank
            if len(two) == 2:
                out[(two[0] << _BITS) + two[1]] = rank
    return out


class RankMap:
    """A pair of ids -> rank in two lookups, for arrays of pairs. Each left id has a place in a table of slots,
    where its right ids are added to it; the places are such that no slot is used twice."""

    def __init__(self, pairs: dict[int, int], ids: int):
        keys = np.array(sorted(pairs), np.int64)
        left, right = keys >> _BITS, keys & (_NONE - 1)
        rank = np.array([pairs[k] for k in keys.tolist()], np.int64)
        first = np.flatnonzero(np.append(True, left[1:] != left[:-1])[: len(left)])
        spans = sorted(zip(first.tolist(), np.append(first[1:], len(left)).tolist()), key=lambda x: x[0] - x[1])
        self.places = np.zeros(ids + 1, np.int64)
        room = 3 * len(keys) + 64  # places; a left id looks for its own from one by its number on
        slots = np.full(room + ids + 65, 1 << 2 * _BITS, np.int64)  # empty: no left id's
        free = np.ones(len(slots), bool)
        for a, b in spans:  # those with many right ids first
            r, at = right[a:b], int(left[a]) * _SPREAD % room
            for _ in range(room // 64 + 2):
                fits = free[np.arange(at, at + 64)[:, None] + r].all(axis=1)
                if fits.any():
                    break
                at = (at + 64) % room
            else:
                raise ValueError("no place for the pairs of a piece")
            at += int(np.argmax(fits))
            self.places[left[a]] = at
            slots[at + r] = (left[a] << _BITS) + rank[a:b]
            free[at + r] = False
        self.slots = np.append(slots, np.full(64, slots[-1]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs that don't merge have the rank 2**18."""
        found = self.slots[self.places[left] + right] ^ (left << _BITS)  # the rank where the slot is this left id's; another's differs in the upper bits
        return np.minimum(found, _NONE)


class Merges:
    """The merges of a vocabulary, for many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.mark = max(ranks.values()) + 1  # stands behind each word and merges with nothing
        self.rank = RankMap(pair_ranks(ranks), self.mark)
        self.base = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def __call__(self, words: pa.Array) -> pa.Array:
        """The ids of each word: list<int32>."""
        some = [self._merged(x.column(0)) for x in text_slices(pa.RecordBatch.from_arrays([words], names=["word"]), 0)]
        return pa.concat_arrays([*some, pa.array([], pa.list_(pa.int32()))])

    def _merged(self, words: pa.Array) -> pa.Array:
        """In each step the leftmost pair of the lowest rank of every word becomes one piece; words without a pair leave."""
        data, ends = text_buffer(words)
        who, length = np.arange(len(words)), np.diff(ends) + 1
        ids = np.full(len(data) + len(words), self.mark, np.int64)
        ids[np.arange(len(data)) + np.repeat(who, length - 1)] = self.base[data]
        rank = np.append(self.rank(ids[:-1], ids[1:]), _NONE)
        done = [(who[:0], length[:0], ids[:0])]
        while len(who):
            low = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), np.cumsum(length) - length)
            going = low < _NONE << 32
            keep = np.repeat(going, length)
            over = ids[~keep]
            done.append((who[~going], length[~going] - 1, over[over != self.mark]))
            new, at = low[going] >> 32, low[going] & (1 << 32) - 1
            ids[at] = new
            rank[at], rank[at - 1] = self.rank(new, ids[at + 2]), self.rank(ids[at - 1], new)  # before the first piece: a mark, or the last one
            keep[at + 1] = False
            who, length, ids, rank = who[going], length[going] - 1, ids[keep], rank[keep]
        who, n, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(who)
        first, n = (np.cumsum(n) - n)[order], n[order]
        ends = np.append(0, np.cumsum(n))
        flat = ids[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word, by the same merges: the leftmost pair of the lowest rank each time."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # of the piece at each place
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i] if ends[i] else n
        if j == n or ends[j] != stop:  # one of the two has been merged since
            continue
        ends[i], ends[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and word[a : ends[b]] in ranks:
                heapq.heappush(heap, (ranks[word[a : ends[b]]], a, ends[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


class Folded:
    """Words with their ids, found by hash: some arrays, which are sent to every task."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        data, ends = text_buffer(words)
        raw = data.tobytes()
        h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())), np.uint64, len(words))
        order = np.argsort(h)
        data, self.word_ends = text_buffer(words.take(pa.array(order)))
        ids = ids.take(pa.array(order))
        self.hashes, self.words = h[order], data.tobytes()
        self.coded = (-1 - ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)).tobytes()
        self.id_ends = np.append(0, 4 * np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """For each word its ids, each as -1 - id; None for a word that isn't here."""
        out: list[bytes | None] = [None] * len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        at, rows = np.searchsorted(self.hashes, h), np.arange(len(words))
        while len(rows):
            rows, at = rows[at < len(self.hashes)], at[at < len(self.hashes)]
            same = self.hashes[at] == h[rows]
            rows, at = rows[same], at[same]
            ends = (self.word_ends[at], self.word_ends[at + 1], self.id_ends[at], self.id_ends[at + 1])
            for r, a, b, c, d in zip(rows.tolist(), *[x.tolist() for x in ends]):
                if self.words[a:b] == words[r]:
                    out[r] = self.coded[c:d]
            other = np.array([out[r] is None for r in rows.tolist()], bool)  # a word of the same hash
            rows, at = rows[other], at[other] + 1
        return out


_NO_WORDS = Folded(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))


class _Numbers(Runs):
    """Texts -> numbers of words: from 0 for a word to be folded; the ids of others, each as -1 - id."""

    kind = np.dtype(np.int32)

    def __init__(self, pattern: str, ranks: dict[bytes, int], folded: Folded | None = None):
        import regex

        self.find, self.find_runs, self.spaced, self.ranks = regex.compile(pattern).findall, regex.compile(SPACED_RUNS).findall, pattern == SPACED, ranks
        self.folded, self.number, self.settled = folded or _NO_WORDS, {}, {}
        self.count, self.fresh = 0, []

    def odd(self, text: str) -> bool:
        return not self.spaced or "\0" in text

    def alone(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.numbers(self.find(text))), np.int32)

    def numbers(self, words: list[str]) -> list[bytes]:
        if len(self.settled) > KEPT_SETTLED:
            self.settled = {}
        new = list(set(words).difference(self.settled).difference(self.number))
        long, rest = {}, []
        for word, data in zip(new, [w.encode() for w in new]):
            if (rank := self.ranks.get(data)) is not None:
                self.settled[word] = (-1 - rank).to_bytes(4, "little", signed=True)
            elif len(data) > LONGEST:
                long[word] = (-1 - np.array(merge_long(data, self.ranks), np.int32)).tobytes()
            else:
                rest.append((word, data))
        for (word, _), ids in zip(rest, self.folded.find([data for _, data in rest])):
            if ids is not None:
                self.settled[word] = ids
            else:
                self.number[word] = self.count.to_bytes(4, "little")
                self.count += 1
                self.fresh.append(word)
        settled, number = self.settled.get, self.number.get
        return [settled(w) or number(w) or long[w] for w in words]

    def cut(self, texts: list[str]) -> pa.Array:
        return all_cut_at_spaces(texts)

    def learned(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = self.find_runs(joined(runs, "\0"))
        stops = [w == "\0" for w in words]
        coded = iter(self.numbers([w for w in words if w != "\0"]))
        out = [b"" if stop else next(coded) for stop in stops]
        ends = np.cumsum([len(x) for x in out])[np.flatnonzero(stops)] // 4
        return np.frombuffer(b"".join(out), np.int32), ends


def _distinct(pattern: str, ranks):
    """The words of a task that are to be folded, each once (again where it has met very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, runs_of = regex.compile(pattern).findall, regex.compile(SPACED_RUNS).findall
        runs: set[str] = set()
        seen: set[str] = set()
        for whole in batches:
            for batch in text_slices(whole, 0):
                texts = batch.column(0).fill_null("").to_pylist()
                plain = [t for t in texts if pattern == SPACED and "\0" not in t]
                fresh = set(chain.from_iterable(map(cut_at_spaces, plain))) - runs
                words = set(runs_of("\0".join(fresh)))
                words.update(*(find(t) for t in texts if pattern != SPACED or "\0" in t))
                words = [w for w in words - seen if len(b := w.encode()) <= LONGEST and b not in ranks.value[0]]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])
                runs |= fresh
                seen.update(words)
                if len(runs) >= KEPT_WORDS:
                    runs, seen = set(), set()

    return run


def common_words(texts: DataFrame, shared, pattern: str, most: int) -> Folded:
    """Ids of the words that most tasks meet, ``most`` words and COMMON_BYTES at most: folded once for all tasks. Words
    are counted over all texts; the least count that keeps to the bounds is found by a histogram of few rows."""
    counts = texts.mapInArrow(_distinct(pattern, shared), "word string").groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    counts = written(counts.withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "bpe-words")
    held, size, least = 0, 0, None
    for level, n, b in sorted(map(tuple, counts.groupBy("level").agg(F.count("*"), F.sum(F.octet_length("word"))).collect()), reverse=True):
        if held + n > most or size + b > COMMON_BYTES:
            break
        held, size, least = held + n, size + b, level
    if least is None:
        return _NO_WORDS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), shared.value[1](batch.column(0))], names=["word", "ids"])

    words = counts.filter(F.col("level") >= least).repartition(math.ceil(held / _SOME_WORDS)).select("word")
    found = words.mapInArrow(fold, "word string, ids array<int>").toArrow()
    return Folded(found["word"].combine_chunks(), found["ids"].combine_chunks())


def _encoded(pattern: str, shared, folded, pieces):
    """(key, ids) of a task's texts, and with pieces the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, merges = shared.value
        common = folded.value if folded else None
        words, flat, count = _Numbers(pattern, ranks, common), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for whole in batches:
            for batch in text_slices(whole, 1, MANY):
                coded = words.ids(batch.column(1))
                fresh = merges(pa.array(words.fresh, pa.string()))
                flat, count = np.append(flat, fresh.flatten().to_numpy()), np.append(count, np.diff(fresh.offsets.to_numpy()))
                words.fresh = []
                numbers = np.frombuffer(b"".join(coded), np.int32)  # of words that were folded, or -1 - id
                own = numbers >= 0
                n = np.ones(len(numbers), np.int64)
                n[own] = count[numbers[own]]
                ends = np.append(0, np.cumsum(n))
                first = np.arange(len(flat), len(flat) + len(numbers))
                first[own] = (np.cumsum(count) - count)[numbers[own]]
                ids = np.append(flat, -1 - numbers)[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
                data, cuts = ids.astype("<u4").tobytes(), 4 * ends[np.append(0, np.cumsum([len(x) // 4 for x in coded]))]
                each = [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                row = {"key": batch.column(0), "ids": pa.array(each, pa.binary())}
                if pieces:
                    row["decoded"] = pa.array([concatenated(x, pieces.value) for x in each], pa.binary())
                yield pa.RecordBatch.from_pydict(row)
                if words.count >= KEPT_WORDS:
                    words, flat, count = _Numbers(pattern, ranks, common), flat[:0], count[:0]

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", common: int = 0, decoded: bool = False) -> DataFrame:
    """(key, ids): ids as little-endian unsigned 32-bit integers in one binary. A null text counts as
    empty and gives no ids; a null key stays null; repeated rows give a row each; other columns don't
    take part. An empty table gives no rows. ``common`` words at most are folded once for all tasks, in a
    pass of their own; ``decoded`` adds the bytes that ``decode`` gives for the ids, without another pass."""
    ranks, sc = load_ranks(ranks_path), df.sparkSession.sparkContext
    shared = sc.broadcast((ranks, Merges(ranks)))
    folded = sc.broadcast(common_words(df.select(text), shared, pattern, common)) if common else None
    pieces = sc.broadcast({v: k for k, v in ranks.items()}) if decoded else None
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text))
    return rows.mapInArrow(_encoded(pattern, shared, folded, pieces), "key bigint, ids binary" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def concatenated(ids: bytes, pieces: dict[int, bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for: their binary pieces, concatenated. Null ids: null."""
    pieces = df.sparkSession.sparkContext.broadcast({v: k for k, v in load_ranks(ranks_path).items()})

    @F.pandas_udf("binary")
    def join(col):
        return col.map(lambda b: None if b is None else concatenated(b, pieces.value))

    return df.withColumn(out, join(ids))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(documents(spark, sf_dir), path, P.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
