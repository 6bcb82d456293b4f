"""Heuristic metrics of whole scans, in numpy over batches of windows.

The same numbers as the column expressions of functions.heuristics, which suit few rows: there, runs and
classes of each window are cut out by patterns many times over; here a batch is one matrix of residues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import heuristics as H
from .align import _codes, _sum

_CLASSES = (A.ACIDIC, A.BASIC, A.POLAR, A.SMALL, A.HYDROPHOBIC)


def _scaled(codes: np.ndarray, scale: dict[str, float]) -> np.ndarray:
    lo, hi = min(scale.values()), max(scale.values())
    return (_sum(np.array([scale[a] for a in A.ALPHABET])[codes]) / codes.shape[1] - lo) / (hi - lo)


def _longest(on: np.ndarray) -> np.ndarray:
    """The longest run of true values of each row."""
    best = now = np.zeros(len(on), np.int64)
    for column in on.T:
        now = np.where(column, now + 1, 0)
        best = np.maximum(best, now)
    return best


def metrics(codes: np.ndarray) -> dict[str, np.ndarray]:
    n = codes.shape[1]
    member = lambda letters: np.isin(np.arange(20), [A.ALPHABET.index(x) for x in letters])[codes]
    share = lambda letters: member(letters).sum(axis=1) / n
    group = np.zeros(20, np.int64)
    for k, letters in enumerate(_CLASSES):
        group[[A.ALPHABET.index(x) for x in letters]] = k
    kinds = group[codes]
    entropy = np.zeros(len(codes))
    for k in range(len(_CLASSES)):
        p = (kinds == k).sum(axis=1) / n
        entropy -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0)
    same = np.hstack([np.zeros((len(codes), 1), bool), codes[:, 1:] == codes[:, :-1]])
    return dict(
        zip(
            H.METRICS,
            (
                _scaled(codes, A.SURFACE), _scaled(codes, A.FLEX), share(A.POLAR_OR_CHARGED), share(A.ACIDIC), share(A.BASIC), share(A.SMALL), share(A.HYDROPHOBIC),
                entropy / np.log2(min(5, n)) if n > 1 else entropy, (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1) / (n - 1) if n > 1 else entropy,
                (_longest(same) + 1) / n, _longest(member(A.ACIDIC)) / n, _longest(member(A.BASIC)) / n, _longest(member(A.CHARGED)) / n,
            ),
        )
    )


def sliding_metrics(codes: np.ndarray, n: int, m: int) -> dict[str, np.ndarray]:
    """The metrics of the m windows of n residues that begin at each place of a row of codes: sums of shifted
    rows and differences of running counts, so that a letter is looked up once for all its windows."""
    member = lambda letters: np.isin(np.arange(20), [A.ALPHABET.index(x) for x in letters])[codes]

    def count(on: np.ndarray, first: int = 0) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(on)])
        return running[n : n + m] - running[first : first + m]

    def scaled(scale: dict[str, float]) -> np.ndarray:
        values, total = np.array([scale[a] for a in A.ALPHABET])[codes], np.zeros(m)
        for i in range(n):
            total = total + values[i : i + m]
        lo, hi = min(scale.values()), max(scale.values())
        return (total / n - lo) / (hi - lo)

    place = np.arange(len(codes), dtype=np.int32)

    def longest(began: np.ndarray) -> np.ndarray:
        """The longest run within each window; began: where the run that each place is in began (the place after it: in none)."""
        run, best = place - began + 1, np.zeros(m, np.int32)
        for i in range(n):
            best = np.maximum(best, np.minimum(run[i : i + m], i + 1))
        return best

    began = lambda on: np.maximum.accumulate(np.where(on, np.int32(0), place + 1))
    group = np.zeros(20, np.int64)
    for k, letters in enumerate(_CLASSES):
        group[[A.ALPHABET.index(x) for x in letters]] = k
    kinds, entropy = group[codes], np.zeros(m)
    p = np.arange(n + 1) / n
    share = p * np.log2(np.where(p > 0, p, 1.0))
    for k in range(len(_CLASSES)):
        entropy = entropy - share[count(kinds == k)]
    changes = np.append(False, kinds[1:] != kinds[:-1])
    new = np.append(True, codes[1:] != codes[:-1])
    values = (
        scaled(A.SURFACE), scaled(A.FLEX), *(count(member(x)) / n for x in (A.POLAR_OR_CHARGED, A.ACIDIC, A.BASIC, A.SMALL, A.HYDROPHOBIC)),
        entropy / np.log2(min(5, n)) if n > 1 else entropy, count(changes, 1) / (n - 1) if n > 1 else entropy,
        longest(np.maximum.accumulate(np.where(new, place, np.int32(0)))) / n, *(longest(began(member(x))) / n for x in (A.ACIDIC, A.BASIC, A.CHARGED)),
    )
    return dict(zip(H.METRICS, values))


def add_metrics(windows: DataFrame, length: int) -> DataFrame:
    """Adds the 13 metrics to valid windows of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("window"))
            if len(texts):
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, metrics(_codes(texts, length)).values())], names=[*batch.schema.names, *H.METRICS])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    return windows.mapInArrow(run, f"{types}, {', '.join(f'{m} double' for m in H.METRICS)}")


def add_bonus(windows: DataFrame, length: int, weights: H.BonusWeights = H.BonusWeights()) -> DataFrame:
    """Adds the bonus, rounded to 9 decimals, so that equal windows and close sums compare alike."""
    full = add_metrics(windows, length)
    return full.select(*windows.columns, F.round(H.bonus({m: F.col(m) for m in H.METRICS}, weights), 9).alias("bonus"))
