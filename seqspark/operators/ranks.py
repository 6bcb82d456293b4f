"""Exact ranks of given sequences among all windows of a scan.

The targets' final scores are sorted once; a window finds its place among them by binary search, so a task
counts windows by place, not target by target, and running sums of the places give every target's rank. The
plan is the same for three targets as for five thousand, and no window becomes a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import heuristics as H
from ..functions.scoring import Profile, rescues
from . import align as L
from .blocks import Block, blocks
from .metrics import sliding_metrics

#: Kinds of counted rows: windows by place, windows equal to a target's sequence, entries by place.
_WINDOWS, _SAME, _ENTRIES, _RECORD = range(4)
_RESULT = """label string, sequence string, score double, bonus double, final double, total bigint, better bigint, equal_score bigint, same_sequence bigint, rank bigint,
    percent double, entries bigint, entry_rank bigint, entry_percent double, entry_equal bigint"""


def _scorer(profile: Profile, rescue: str, bonus: bool):
    """(scores, bonuses) of the windows of a block."""
    table, full = np.array([p.scores() for p in profile]), rescues(profile, rescue)

    def scores(block: Block) -> tuple[np.ndarray, np.ndarray]:
        at = block.at
        if full:
            score = np.concatenate([np.zeros(0), *(L._sum(L.rescue_scores(block.matrix(at[lo : lo + (1 << 15)]), table, profile)) for lo in range(0, len(at), 1 << 15))])
        else:
            score = block.summed(table)[at]
        extra = np.round(H.bonus(sliding_metrics(block.safe, len(profile), block.m), H.BonusWeights(), float, np.maximum), 9)[at] if bonus else np.zeros(len(at))
        return score, extra

    return scores


def _places(values: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many found numbers lie between the values before and at each place (one more place than values), and equal the value."""
    at = np.searchsorted(values, found, side="right")
    equal = at[(at > 0) & (values[np.maximum(at, 1) - 1] == found)] - 1 if len(values) else at[:0]
    return np.bincount(at, minlength=len(values) + 1), np.bincount(equal, minlength=len(values) + 1)


def _rows(kind: int, n: np.ndarray, equal: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero((n > 0) | (equal > 0))
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(some), kind, np.int32)), "place": pa.array(some.astype(np.int32)), "n": pa.array(n[some].astype(np.int64)), "equal": pa.array(equal[some].astype(np.int64))})


def window_ranks(records: DataFrame, profile: Profile, targets: list[tuple[str, str]], rescue: str = "full", bonus: bool = True) -> DataFrame:
    """(label, sequence, score, bonus, final, total, better, equal_score, same_sequence, rank, percent, and the same of entries)
    of each target, in their order. final is score less bonus, rounded to 9 digits, and comes from the same
    numbers for targets and windows. Entries are headers with their least score; of records with the same
    header the last counts. Percentiles of no windows or entries are null. The scan runs once; tasks, and the
    one that puts the counts together, hold a few numbers for each target."""
    n = len(profile)
    if bad := [s for _, s in targets if len(s) != n or set(s) - set(A.ALPHABET)]:
        raise ValueError(f"targets must be {n} residues: {bad}")
    scores = _scorer(profile, rescue, bonus)
    given = Block([(i, 0, np.frombuffer(s.encode(), np.uint8), 0, 1) for i, (_, s) in enumerate(targets)], n, 0) if targets else None
    score, extra = scores(given) if given else (np.zeros(0), np.zeros(0))
    final = np.round(score - extra, 9)
    values, number = np.unique(final), {s: i for i, s in enumerate(sorted({s for _, s in targets}))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, equal, same = np.zeros(len(values) + 1, np.int64), np.zeros(len(values) + 1, np.int64), np.zeros(len(number) + 1, np.int64)
        for batch in batches:
            least = np.full(batch.num_rows, np.inf)
            for block in blocks(batch, n, 0):
                if not len(block.at):
                    continue
                found = np.round(np.subtract(*scores(block)), 9)
                a, b = _places(values, found)
                whole, equal = whole + a, equal + b
                hit = block.at[np.isin(found, values)]
                kinds, times = np.unique(np.ascontiguousarray(block.matrix(hit).astype(np.uint8)).view(f"V{n}").ravel(), return_counts=True)
                for letters, k in zip(kinds, times.tolist()):
                    sequence = "".join(A.ALPHABET[c] for c in letters.tobytes())
                    if sequence in number:
                        same[number[sequence]] += k
                row = block.row[np.searchsorted(block.base, block.at, side="right") - 1]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                least[row[first]] = np.minimum(least[row[first]], np.minimum.reduceat(found, first))
            some = np.flatnonzero(least < np.inf)
            given = batch.select(batch.schema.names[:-1]).take(pa.array(some))
            yield full(pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(some), _RECORD, np.int32)), "header": given.column(1), "record_ord": given.column(0), "f": pa.array(least[some])}), batch.schema)
        if whole.any():
            yield full(_rows(_WINDOWS, whole, equal), batch.schema)
            yield full(_rows(_SAME, same, same), batch.schema)

    def full(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        have, size = dict(zip(rows.schema.names, rows.columns)), rows.num_rows
        kinds = {"kind": pa.int32(), "place": pa.int32(), "n": pa.int64(), "equal": pa.int64(), "header": schema.field(1).type, "record_ord": schema.field(0).type, "f": pa.float64()}
        return pa.RecordBatch.from_pydict({c: have.get(c, pa.nulls(size, t)) for c, t in kinds.items()})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries become counts by place; other counts go on."""
        for batch in batches:
            record = batch.column(0).to_numpy() == _RECORD
            yield batch.select(["kind", "place", "n", "equal"]).filter(pa.array(~record))
            yield _rows(_ENTRIES, *_places(values, batch.column(4).to_numpy(zero_copy_only=False)[record]))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {k: np.zeros((2, max(len(values), len(number)) + 1), np.int64) for k in (_WINDOWS, _SAME, _ENTRIES)}
            for r in batch.column(0).to_pylist()[0]:
                table[r["kind"]][:, r["place"]] += (r["n"], r["equal"])
            at, own = np.searchsorted(values, final), np.array([number[s] for _, s in targets], np.int64)
            (seen, tied), (entered, level) = table[_WINDOWS], table[_ENTRIES]
            better, above = np.cumsum(seen)[at], np.cumsum(entered)[at]
            total, headers = int(seen.sum()), int(entered.sum())
            share = lambda x, of: pa.array(100.0 * (x + 1) / of) if of else pa.nulls(len(x), pa.float64())
            same_for_all = lambda x: pa.array(np.full(len(targets), x, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in targets], pa.string()), pa.array([s for _, s in targets], pa.string()), pa.array(score), pa.array(extra), pa.array(final), same_for_all(total),
                    pa.array(better), pa.array(tied[at]), pa.array(table[_SAME][0][own]), pa.array(better + 1), share(better, total), same_for_all(headers), pa.array(above + 1), share(above, headers), pa.array(level[at]),
                ],
                names=[x.split()[0] for x in _RESULT.split(",")],
            )

    source = records.select("record_ord", "header", "sequence")
    kind = source.schema["record_ord"].dataType.simpleString()
    counted = source.mapInArrow(count, f"kind int, place int, n bigint, equal bigint, header string, record_ord {kind}, f double")
    # Sums combine before the shuffle; of an entry's records the last stays.
    merged = counted.groupBy("kind", "place", "header").agg(F.sum("n").alias("n"), F.sum("equal").alias("equal"), F.max_by("f", "record_ord").alias("f"))
    placed = merged.select("kind", "place", "n", "equal", "f").mapInArrow(entries, "kind int, place int, n bigint, equal bigint")
    few = placed.groupBy("kind", "place").agg(F.sum("n").alias("n"), F.sum("equal").alias("equal"))  # three rows a target at most
    return few.agg(F.collect_list(F.struct("kind", "place", "n", "equal")).alias("counts")).mapInArrow(together, _RESULT)
