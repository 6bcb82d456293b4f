"""Operators 8 and 10: exact top-k by MaxScore, and nearest neighbours by a permutation index.

Both put all vectors into shards and the queries into blocks; a task holds one shard and one block (some
MB each) and gives each query's best rows of its shard, which one window per query merges. Work grows as
queries times rows, as a search of every row asks; memory doesn't grow. Shards go by hash of the row's
id, so that equal or clustered vectors spread; no table is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Rows of a shard and of a block of queries: alike, since the shuffle sends each side once for each part of the other.
SHARD, BLOCK = 8192, 8192


def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: null vectors and those with null or
    non-finite components don't, nor do rows without an id."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    return max((int(c.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for c in columns if len(c)), default=0)


def in_cells(rows: DataFrame, every: int, search, schema: str) -> DataFrame:
    """Each block of queries (ids divisible by ``every``) with each shard of rows: search(rows, queries)."""
    n, q = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(q / BLOCK))
    spread = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.filter(F.col("vec_id") % every == 0)
    left = rows.withColumn("shard", spread(shards)).withColumn("block", all_of(blocks))
    right = queries.withColumn("block", spread(blocks)).withColumn("shard", all_of(shards))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, schema)


def merged(found: DataFrame, k: int, best_first) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(best_first, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def max_score(query: np.ndarray, ids: np.ndarray, postings: np.ndarray, top: np.ndarray, low: np.ndarray, own: int, k: int, step: int = 8):
    """(ids, scores) of the query's k best rows of a shard. postings: a row for each term (component).

    Terms are taken by their greatest possible share of the score. The first few are essential: all rows
    of their postings are added up. Once the terms left can lift a row at most to less than the k-th best
    score known, they are non-essential: they are probed only for rows still competitive."""
    bound = np.maximum(query * top, query * low)
    order = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
    alive = np.flatnonzero(ids != own)
    part, least = np.zeros(len(alive)), -np.inf
    for at in range(0, len(order), step):
        terms = order[at : at + step]
        part += query[terms] @ postings[np.ix_(terms, alive)] if at else query[terms] @ postings[terms][:, alive]
        if len(alive) > k:
            if at == 0:  # the full scores of the most promising rows give a first threshold
                some = alive[np.argpartition(-part, k - 1)[: 4 * k]]
                least = np.partition(query @ postings[:, some], len(some) - k)[len(some) - k]
            else:
                least = max(least, np.partition(part, len(part) - k)[len(part) - k] - _fall(query, top, low, order[at + step :]))
            keep = part + rest[min(at + step, len(order))] >= least
            if not keep.all():
                alive, part = alive[keep], part[keep]
    best = np.lexsort((ids[alive], -part))[:k]
    return ids[alive][best], part[best]


def _fall(query, top, low, terms) -> float:
    """The most that the terms left can take from a score."""
    return -np.minimum(query[terms] * top[terms], query[terms] * low[terms]).sum()


def _largest(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0.0)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products of whole numbers of any size: in 64-bit integers where they fit, else in Python's."""
    bound = max(1, rows.shape[1]) * _largest(rows) * _largest(query[None, :])[0]
    out, fits = [0] * len(rows), bound < 2**62
    for i, x in zip(np.flatnonzero(fits).tolist(), (rows[fits].astype(np.int64) @ query.astype(np.int64)).tolist() if fits.any() else []):
        out[i] = x
    whole = [int(x) for x in query] if not fits.all() else []
    for i in np.flatnonzero(~fits).tolist():
        out[i] = sum(int(a) * b for a, b in zip(rows[i], whole))
    return out


def _max_score_cell(k: int, scale: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            width = widest(rows["v"], queries["v"])
            c, q = np.floor(scale * matrix(rows["v"], width)), np.floor(scale * matrix(queries["v"], width))
            ids, postings = rows["vec_id"].to_numpy(), np.ascontiguousarray(c.T)
            top, low = c.max(axis=0), c.min(axis=0)
            large = _largest(c)
            for own, x, most in zip(queries["vec_id"].to_pylist(), q, _largest(q).tolist()):
                apart = max(1, width) * large * most >= 2**53  # pairs whose products doubles can't hold
                if not apart.any():
                    found, scores = max_score(x, ids, postings, top, low, own, k)
                    best = [(int(s), i) for i, s in zip(found.tolist(), scores)]
                else:
                    near = np.flatnonzero(~apart)
                    found, scores = max_score(x, ids[near], np.ascontiguousarray(postings[:, near]), c[near].max(axis=0, initial=0), c[near].min(axis=0, initial=0), own, k) if len(near) else ([], [])
                    far = np.flatnonzero(apart & (ids != own))
                    best = [(int(s), int(i)) for i, s in zip(found, scores)] + list(zip(exact_scores(x, c[far]), ids[far].tolist()))
                    best = sorted(best, key=lambda r: (-r[0], r[1]))[:k]
                if any(not -(2**63) <= s < 2**63 for s, _ in best):
                    raise OverflowError(f"a score of query {own} doesn't fit 64 bits")
                out["query_id"] += [own] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [s for s, _ in best]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return search


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product of floor(scale * x).

    A missing trailing component is zero. Rows with the query's id are its own. Ties go to the smaller
    id. Empty tables and tables without a query give no rows. Scores are exact whatever the components' size;
    a score that 64 bits can't hold is an error where it is among a query's k best of a shard."""
    found = in_cells(sound(df, key, vector), every, _max_score_cell(k, scale), "query_id bigint, vec_id bigint, score bigint")
    return merged(found, k, F.col("score").desc())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(documents(spark, sf_dir, "embeddings"))


# Permutation index

_RERANKED = 1024  # rows measured at a time


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    return np.argsort(squared(vectors, pivots), axis=1, kind="stable")[:, :length]


def footrule_gains(query: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], rows: int, length: int) -> np.ndarray:
    """How much nearer each row is, by footrule, than a row that shares no pivot with the query; a pivot
    that one of the two lacks counts as at place ``length``. Reads the query's pivots' files only."""
    gain = np.zeros(rows, np.int32)
    for place, pivot in enumerate(query):
        row, at = files[pivot]
        gain[row] += (length - place) + (length - at) - np.abs(at - place)
    return gain


def apart(drawn: np.ndarray, n: int) -> list[int]:
    """Numbers of the first n rows that lie apart: none near an earlier one (a quarter of a wide distance)."""
    d = squared(drawn, drawn)
    near, out = np.quantile(d, 0.9) / 16 if len(d) else 0.0, []
    for i in range(len(drawn)):
        if len(out) < n and (not out or d[i, out].min() > near):
            out.append(i)
    return out


def _permutation_cell(pivots: list[np.ndarray], k: int, length: int, share: float):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            width = max(widest(rows["v"], queries["v"]), pivots[0].shape[1])
            c, q = matrix(rows["v"], width), matrix(queries["v"], width)
            ids, take = rows["vec_id"].to_numpy(), min(len(c), max(20 * k, math.ceil(share * len(c))))
            indexes = []
            for p in pivots:
                p = np.pad(p, ((0, 0), (0, width - p.shape[1])))
                m = min(length, len(p))
                perm = nearest_pivots(c, p, m)
                # The inverted file of each pivot: rows, and the pivot's place among the row's nearest.
                flat = np.argsort(perm.ravel(), kind="stable")
                cuts = np.searchsorted(perm.ravel()[flat], np.arange(len(p) + 1))
                files = [((flat[a:b] // m), (flat[a:b] % m).astype(np.int32)) for a, b in zip(cuts, cuts[1:])]
                indexes.append((files, m, nearest_pivots(q, p, m)))
            for at, (own, x) in enumerate(zip(queries["vec_id"].to_pylist(), q)):
                near = np.zeros(len(c), bool)
                for files, m, places in indexes:
                    gain = footrule_gains(places[at], files, len(c), m)
                    near |= gain >= np.partition(gain, len(c) - take)[len(c) - take]  # all that tie with the row at the cut
                some = np.flatnonzero(near & (ids != own))
                d = np.sqrt(np.concatenate([((c[part] - x) ** 2).sum(axis=1) for part in np.split(some, range(_RERANKED, len(some), _RERANKED))]))
                best = np.lexsort((ids[some], d))[:k]
                out["query_id"] += [own] * len(best)
                out["vec_id"] += ids[some][best].tolist()
                out["score"] += d[best].tolist()
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(x, kinds[n]) for n, x in out.items()})

    return search


def nearest(df: DataFrame, k: int = 10, every: int = 100, pivots: int = 256, length: int = 96, share: float = 0.1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by Euclidean distance, as the index
    finds them. ``pivots`` rows, those of least hash, are the pivots; every row is posted under its
    ``length`` nearest pivots; the ``share`` of a shard that is nearest by footrule, with all rows that tie
    with its last, is ranked by distance. Where pivots lie close together (a large cluster, copies), as many
    that lie apart form a second index, and what either finds is ranked.

    A missing trailing component is zero. Zero vectors take no part. Rows with the query's id are its
    own. Ties go to the smaller id. Empty tables and tables without a query give no rows."""
    rows = sound(df, key, vector).filter(F.exists("v", lambda x: x != 0))
    drawn = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()]
    p = np.zeros((len(drawn), max(map(len, drawn), default=0)))
    for i, v in enumerate(drawn):
        p[i, : len(v)] = v
    spread = apart(p, pivots)
    sets = [p[:pivots]] + ([p[spread]] if spread != list(range(min(pivots, len(p)))) else [])
    found = in_cells(rows, every, _permutation_cell(sets, k, length, share), "query_id bigint, vec_id bigint, score double")
    return merged(found, k, F.col("score"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"))
