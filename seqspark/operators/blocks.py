"""Scans that keep few windows, over blocks of letters in numpy.

A row per window costs more than its score: a string, a row and a batch for each letter of the records. Here
a task takes the residue codes of many records as one row of numbers, with a mark between records; sums over
windows are sums of shifted rows. Only windows that can enter the result become rows: those under the
threshold, or each task's best. Costly scores (rescue, alignment) are found only where a bound from below,
the least energy that each position can reach there, doesn't rule the window out already.

Results equal those of the windows one by one (scan.score_windows); tests hold both against each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import heuristics as H
from ..functions.scoring import Profile, rescues
from . import align as L
from .metrics import sliding_metrics

#: Letters of a block; longer records are cut into several, with what their windows need of the next.
BLOCK = 1 << 17
_PLACES = 1 << 14  # that a bound is found for at once
_FAR, _SLACK = 1e18, 1e-6  # no energy there; what roundings may differ by
_LETTERS = np.frombuffer(A.ALPHABET.encode(), np.uint8)


class Block:
    """Codes of some records (-1: other letters and the ends of records) and the windows in them."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray, int, int]], length: int, flank: int):
        """parts: row, place of the first letter in its record, letters, first and last + 1 place of windows."""
        self.length, self.flank = length, flank
        self.edge = np.full(length + 2 * flank + 2, -1, np.int64)
        pieces, self.base, at = [self.edge], [], len(self.edge)
        for _, _, letters, _, _ in parts:
            self.base.append(at)
            pieces += [L._CODE[letters], self.edge[:1]]
            at += len(letters) + 1
        self.codes = np.concatenate([*pieces, self.edge])
        self.safe = np.maximum(self.codes, 0)
        self.bad = np.concatenate([[0], np.cumsum(self.codes < 0)])
        self.row, self.place = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        self.base, self.end = np.array(self.base), np.array(self.base) + [len(p[2]) for p in parts]
        self.m = len(self.codes) - length + 1
        valid = self.bad[length : length + self.m] == self.bad[: self.m]
        for base, (_, place, letters, first, last) in zip(self.base.tolist(), parts):
            valid[base : base + first - place] = valid[base + last - place : base + len(letters)] = False
        self.at = np.flatnonzero(valid)  # where windows begin

    def summed(self, table: np.ndarray) -> np.ndarray:
        """Plain scores of windows at each place, added from left to right."""
        total = np.zeros(self.m)
        for i, energies in enumerate(table):
            total = total + energies[self.safe[i : i + self.m]]
        return total

    def matrix(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.safe, self.length)[at]

    def sides(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many letters of its flanks each window has, and whether all letters of its region are residues."""
        part = np.searchsorted(self.base, at, side="right") - 1
        left, right = np.minimum(self.flank, at - self.base[part]), np.minimum(self.flank, self.end[part] - at - self.length)
        return left, right, self.bad[at + self.length + right] == self.bad[at - left]

    def rows(self, batch: pa.RecordBatch, at: np.ndarray, regions: bool) -> pa.RecordBatch:
        """The windows as rows of scan.windows."""
        part = np.searchsorted(self.base, at, side="right") - 1
        start = self.place[part] + at - self.base[part] + 1
        columns = batch.select(batch.schema.names[:-1]).take(pa.array(self.row[part])).columns  # not the sequences
        letters = lambda a, b: _LETTERS[self.safe[a:b]].tobytes().decode()
        texts = [letters(a, a + self.length) for a in at.tolist()]
        out = [*columns, pa.array(start), pa.array(start + self.length - 1), pa.array(texts, pa.string())]
        if regions:
            left, right, _ = self.sides(at)
            out += [pa.array([letters(a - x, a + self.length + y) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist())], pa.string()), pa.array(start - left)]
        names = [*batch.schema.names[:-1], "start", "end", "window", *(["region", "region_from"] if regions else [])]
        return pa.RecordBatch.from_arrays(out, names=names)


def blocks(batch: pa.RecordBatch, length: int, flank: int) -> Iterator[Block]:
    """The records of a batch (its last column: sequences) that have windows, in blocks."""
    column = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    parts, size = [], 0
    for row, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        for first in range(0, b - a - length + 1, BLOCK):
            last = min(first + BLOCK, b - a - length + 1)
            lo, hi = max(0, first - flank), min(b - a, last + length - 1 + flank)
            parts.append((row, lo, data[a + lo : a + hi], first, last))
            size += hi - lo
            if size >= BLOCK:
                yield Block(parts, length, flank)
                parts, size = [], 0
    if parts:
        yield Block(parts, length, flank)


class Best:
    """The first k rows by an order, as they come; all rows without k."""

    def __init__(self, k: int | None, order: list[tuple[str, str]]):
        self.k, self.order, self.rows, self.done = k, order, None, []

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        if self.k is None:
            self.done.append(batch)
            return
        table = pa.Table.from_batches([batch] if self.rows is None else [*self.rows.to_batches(), batch])
        self.rows = table.sort_by(self.order).slice(0, self.k).combine_chunks()

    def worst(self) -> float | None:
        """The k-th value, if there are k."""
        return self.rows[self.order[0][0]][-1].as_py() if self.rows is not None and len(self.rows) == self.k else None

    def ready(self) -> list[pa.RecordBatch]:
        done, self.done = self.done, []
        return done

    def last(self) -> list[pa.RecordBatch]:
        return self.rows.to_batches() if self.rows is not None else []


class Bound:
    """A bound from below on the score of each window of a block: for each start of an alignment the least that
    each position can take from the letters it can meet, summed over prefixes of the query, so that alignments
    of one start share it. A position is at one place, or the next after a skipped letter; donors are beside it."""

    def __init__(self, table: np.ndarray, profile: Profile, rescue: bool, context: dict[str, np.ndarray], flank: int, max_gaps: int | None, least: int | None, weight: float):
        n = len(profile)
        self.profile, self.flank, self.weight = profile, flank, weight
        self.gaps, self.least = bool(max_gaps), (n if max_gaps is None else max(1, n - 1) if least is None else least)
        size = n + 2 * flank
        self.starts = [(qs, ts) for qs in range(n - self.least + 1) for ts in range(size - self.least + 1)] if max_gaps is not None else [(0, 0)]
        suits = [self._suits(p) if rescue and p.residue in A.RESCUERS else None for p in profile]
        self.direct = [np.append(t, _FAR) for t in table]
        self.suited = [None if x is None else np.append(np.where(x, t, _FAR), _FAR) for x, t in zip(suits, table)]
        self.floor = {r: float(np.nanmin(t)) for r, t in context.items() if not np.isnan(t).all()} if rescue else {}

    def __call__(self, block: Block) -> np.ndarray:
        """For the windows at block.at; some thousand places at a time, whose rows stay in the caches."""
        edge = len(block.edge)
        best = np.empty(len(block.codes) - 2 * edge)
        for lo in range(0, len(best), _PLACES):
            part = best[lo : lo + _PLACES]
            part[:] = self._least(block.codes[lo : lo + len(part) + 2 * edge], edge)
        return best[block.at - edge]

    def _least(self, codes: np.ndarray, edge: int) -> np.ndarray:
        """For each place but the edges. What a position can take depends on its place in the region by which of
        the letters beside it are in the region alone, so starts share it: rows of all places, read at a shift."""
        n, count, last = len(self.profile), len(codes) - 2 * edge, len(self.profile) + self.flank - 1
        width, known = count + self.flank + last, {}
        energies = [t[codes] for t in self.direct]  # a code of -1 is the last entry
        suited = [None if t is None else t[codes] for t in self.suited]

        def near(row: np.ndarray, inside: tuple[bool, ...], *places: int) -> np.ndarray:
            found = [row[edge - self.flank + p : edge - self.flank + p + width] for p in places if inside[p + 1]]
            return np.minimum(*found) if len(found) > 1 else found[0] if found else np.full(width, _FAR)

        def taken(i: int, inside: tuple[bool, ...]) -> np.ndarray:
            """The least that a position takes where these of the letters from the one before are in the region."""
            one = near(energies[i], inside, *((0, 1) if self.gaps else (0,)))
            if suited[i] is None:
                return one
            left, right = (near(suited[i], inside, *p) for p in (((-1, 0), (1, 2)) if self.gaps else ((-1,), (1,))))
            first = np.minimum(left, right)
            one = np.minimum(one, first)
            if self.profile[i].charged:
                if (floor := self.floor.get(self.profile[i].residue)) is not None:
                    one = np.minimum(one, min(floor, A.SECOND_DONOR_CAP * floor))
                    first = np.minimum(first, floor)
                    left = right = np.minimum(np.minimum(left, right), floor)
                second = np.maximum(left, right)
                one = np.where(second < 0, np.minimum(one, first + A.SECOND_DONOR_WEIGHT * second), one)
            return one

        def at(i: int, o: int, *beside: int) -> np.ndarray:
            """What position i takes at place o of the region, eased by the letters beside the alignment."""
            inside = tuple(-self.flank <= o + p <= last for p in (-1, 0, 1, 2))
            if (i, inside) not in known:
                known[i, inside] = taken(i, inside)
            one = known[i, inside]
            if beside and self.weight:
                if (i, inside, beside) not in known:
                    known[i, inside, beside] = one + self.weight * np.minimum(0.0, near(energies[i], inside, *beside) - one)
                one = known[i, inside, beside]
            return one[o + self.flank : o + self.flank + count]

        best = np.full(count, _FAR)
        for qs, ts in self.starts:
            before = None
            for i in range(qs, n):
                o, k = ts + i - qs - self.flank, i + 1 - qs
                if o > last:
                    break
                ahead = at(i, o, *((-1, 0) if self.gaps else (-1,))) if before is None else None
                if k >= self.least:
                    behind = at(i, o, *((1, 2) if self.gaps else (1,)))
                    np.minimum(best, np.minimum(ahead, behind) if before is None else before + behind, out=best)
                before = ahead if before is None else before + at(i, o)
        return best

    @staticmethod
    def _suits(p) -> np.ndarray:
        return np.array([x in A.RESCUERS[p.residue] for x in A.ALPHABET])


COUNTS = ("windows_scanned", "prefilter_passed", "scored_windows", "threshold_passed")


def scan_hits(
    records: DataFrame, profile: Profile, k: int | None, mode: str = "raw", floor: float = 1.0, rescue: str = "full", alignment: str = "rigid", prefilter: float | None = None,
    prefilter_mode: str = "raw", threshold: float | None = None, flank: int = 1, keep: tuple[str, ...] = (), context=None, digits: int | None = None,
    observe: Observation | None = None, counts_only: bool = False, **options,
) -> DataFrame:
    """The windows of scan.score_windows under the threshold, or (without one) each task's k best by score,
    record_ord and start. digits: scores are rounded to so many before they compare. An observation gets the
    numbers of windows scanned, passing the prefilter, scored and passing the threshold from the same pass;
    counts_only: a row of these for each record instead of its hits."""
    n, rigid, k = len(profile), alignment == "rigid", None if threshold is not None else k
    table, pre = (np.array([p.scores(m, floor) for p in profile]) for m in (mode, prefilter_mode))
    known = {r: np.array(t) for r, t in (context or {}).items()}
    full = rescues(profile, rescue)
    add_alignment = None if rigid else L.aligner(profile, mode, floor, rescue, context=context, **options)
    flank = 0 if rigid else flank
    bound = Bound(table, profile, full, known, flank, None if rigid else options.get("max_gaps", 1), options.get("least"), 0.0 if rigid else options.get("flank_weight", 0.5))
    penalty = min(0.0, options.get("gap_penalty", 0.0))
    counted = observe is not None or counts_only

    def rounded(score: np.ndarray) -> np.ndarray:
        return score if digits is None else np.round(score, digits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, counts = Best(k, [(c, "ascending") for c in ("score", "record_ord", "start")]), np.zeros((4, 0), np.int64)

        def least() -> float:
            worst = best.worst() if k else None
            return min(x for x in (threshold, worst, np.inf) if x is not None)

        def count(what: int, block: Block, at: np.ndarray) -> None:
            if counted:
                rows = block.row[np.searchsorted(block.base, at, side="right") - 1]
                counts[what] += np.bincount(rows, minlength=counts.shape[1])

        def take(batch: pa.RecordBatch, block: Block, at: np.ndarray, score: np.ndarray | None) -> None:
            """Rows of windows; their scores are known or to be found."""
            if counts_only and score is not None:
                return
            for lo in range(0, len(at), 1 << 15):
                some = at[lo : lo + (1 << 15)]
                if rigid:
                    s = rounded(L._sum(L.rescue_scores(block.matrix(some), table, profile, known)) if score is None else score[lo : lo + (1 << 15)])
                    good = s <= least()
                    rows = block.rows(batch, some[good], False)
                    rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array(s[good])], names=[*rows.schema.names, "score"])
                else:
                    rows = add_alignment(block.rows(batch, some, True))
                    s = rounded(rows.column(rows.schema.get_field_index("score")).to_numpy())
                    rows = rows.set_column(rows.schema.get_field_index("score"), "score", pa.array(s)).filter(pa.array(s <= least()))
                if threshold is not None and score is None:
                    count(3, block, some[s <= threshold])
                if counts_only:
                    continue
                if k and rows.num_rows > k:  # ties with the k-th value stay
                    s = rows.column(rows.schema.get_field_index("score")).to_numpy()
                    rows = rows.filter(pa.array(s <= np.partition(s, k - 1)[k - 1]))
                best.add(rows)

        for batch in batches:
            counts = np.zeros((4, batch.num_rows), np.int64)
            for block in blocks(batch, n, flank):
                count(0, block, block.at)
                if prefilter is not None:
                    at = block.at
                    score = L._sum(L.rescue_scores(block.matrix(at), pre, profile, known)) if full else block.summed(pre)[at]
                    block.at = at[score <= prefilter]
                    count(1, block, block.at)
                if not rigid:
                    block.at = block.at[block.sides(block.at)[2]]
                count(2, block, block.at)
                at, score = block.at, None
                if rigid and not full:
                    score = rounded(block.summed(table)[at])
                    low = score
                elif k or threshold is not None:
                    low = bound(block) + penalty - _SLACK
                else:
                    low = np.full(len(at), -np.inf)
                if score is not None and threshold is not None:
                    count(3, block, at[score <= threshold])
                if k and score is None and len(at) > 4 * k and least() == np.inf:  # the most promising give a first threshold
                    first = np.argpartition(low, 4 * k)[: 4 * k]
                    take(batch, block, at[first], None)
                    rest = np.ones(len(at), bool)
                    rest[first] = False
                    at, low = at[rest], low[rest]
                if k and score is not None and len(at) > k:
                    near = np.partition(low, k - 1)[k - 1]
                    at, score, low = (x[low <= near] for x in (at, score, low))
                fits = low <= least()
                take(batch, block, at[fits], None if score is None else score[fits])
                yield from best.ready()
            if counted:
                counts[3] = counts[2] if threshold is None else counts[3]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, counts)], names=[*batch.schema.names[:-1], *COUNTS])
        yield from best.last()

    return _run(records, keep, not rigid, run, "score double" if rigid else L.ADDED, observe, counts_only)


def _run(records: DataFrame, keep: tuple[str, ...], regions: bool, run: Callable, added: str, observe: Observation | None, counts_only: bool = False) -> DataFrame:
    source = records.select("record_ord", "header", *keep, "sequence")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{own}, start bigint, end bigint, window string, {'region string, region_from bigint, ' if regions else ''}{added}"
    if counts_only:
        return source.mapInArrow(run, f"{own}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    if observe is None:
        return source.mapInArrow(run, schema)
    types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    made = [x.split() for x in schema.removeprefix(f"{own}, ").split(", ")]
    kinds = {name: types[kind] for name, kind in [*made, *((c, "bigint") for c in COUNTS)]}

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of hits and rows of counts in one schema."""
        given = {}

        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given.update({f.name: f.type for f in batch.schema if f.name != "sequence"})
                yield batch

        for batch in run(read()):
            have = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_pydict({c: have.get(c, pa.nulls(batch.num_rows, t)) for c, t in {**given, **kinds}.items()})

    both = source.mapInArrow(filled, f"{schema}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return both.observe(observe, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).filter(F.col(COUNTS[0]).isNull()).drop(*COUNTS)


def bonus_hits(records: DataFrame, length: int, top_n: int | None = None, threshold: float | None = None, flank: int = 0, keep: tuple[str, ...] = (), weights: H.BonusWeights = H.BonusWeights()) -> DataFrame:
    """The windows of metrics.add_bonus that reach the threshold, or each task's top n of these by bonus. With
    a flank they have their regions, and windows whose region has other letters go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top_n, [("bonus", "descending"), ("record_ord", "ascending"), ("start", "ascending")])
        for batch in batches:
            for block in blocks(batch, length, flank):
                at = block.at if not flank else block.at[block.sides(block.at)[2]]
                bonus = np.round(H.bonus(sliding_metrics(block.safe, length, block.m), weights, float, np.maximum), 9)[at]
                good = np.ones(len(at), bool) if threshold is None else bonus >= threshold
                if top_n and good.sum() > top_n:
                    good &= bonus >= -np.partition(-bonus[good], top_n - 1)[top_n - 1]
                if (worst := best.worst() if top_n else None) is not None:
                    good &= bonus >= worst
                rows = block.rows(batch, at[good], flank > 0)
                best.add(pa.RecordBatch.from_arrays([*rows.columns, pa.array(bonus[good])], names=[*rows.schema.names, "bonus"]))
                yield from best.ready()
        yield from best.last()

    return _run(records, keep, flank > 0, run, "bonus double", None)


def _record_rows(records: DataFrame, length: int, schema: str, measure: Callable[[Block, np.ndarray, int], list[np.ndarray]]) -> DataFrame:
    """(record_ord, *schema): a row for each record with windows in a block. measure gets the block, the number of
    the record of each window (from 0, rising) and how many records these are."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, length, 0):
                if len(block.at):
                    rows, record = np.unique(block.row[np.searchsorted(block.base, block.at, side="right") - 1], return_inverse=True)
                    columns = [pa.array(x) for x in measure(block, record, len(rows))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=["record_ord", *names])

    source = records.select("record_ord", "sequence")
    return source.mapInArrow(run, f"record_ord {source.schema['record_ord'].dataType.simpleString()}, {schema}")


def window_totals(records: DataFrame, length: int) -> DataFrame:
    """(record_ord, n, starts, least) of the records with windows: how many they have, the sum of their starts and
    the first by letters. Tasks add up records, so that no window is shuffled or sorted."""
    rank = np.argsort(np.argsort(_LETTERS))

    def measure(block: Block, record: np.ndarray, many: int) -> list[np.ndarray]:
        part = np.searchsorted(block.base, block.at, side="right") - 1
        starts = np.zeros(many, np.int64)
        np.add.at(starts, record, block.place[part] + block.at - block.base[part] + 1)
        at, own = block.at, record
        for lo in range(0, length, 13):  # so many letters are a number; windows that tie go on to the next
            number = np.zeros(len(at), np.int64)
            for i in range(lo, min(lo + 13, length)):
                number = number * 20 + rank[block.safe[at + i]]
            least = np.full(many, np.iinfo(np.int64).max)
            np.minimum.at(least, own, number)
            at, own = at[number == least[own]], own[number == least[own]]
        at = at[np.unique(own, return_index=True)[1]]
        return [np.bincount(record, minlength=many), starts, np.array([x.tobytes().decode() for x in _LETTERS[block.matrix(at)]], object)]

    found = _record_rows(records, length, "n bigint, starts bigint, least string", measure)
    return found.groupBy("record_ord").agg(F.sum("n").alias("n"), F.sum("starts").alias("starts"), F.min("least").alias("least"))


def metric_means(records: DataFrame, length: int) -> DataFrame:
    """(record_ord, *metrics): the means of the heuristic metrics over each record's windows."""

    def measure(block: Block, record: np.ndarray, many: int) -> list[np.ndarray]:
        values = sliding_metrics(block.safe, length, block.m)
        return [np.bincount(record, minlength=many), *(np.bincount(record, values[m][block.at], many) for m in H.METRICS)]  # added in order

    found = _record_rows(records, length, "n bigint, " + ", ".join(f"{m} double" for m in H.METRICS), measure)
    return found.groupBy("record_ord").agg(*[(F.sum(m) / F.sum("n")).alias(m) for m in H.METRICS])


def bonuses(block: Block, weights: H.BonusWeights = H.BonusWeights()) -> np.ndarray:
    """The bonus of each window, as metrics.add_bonus gives it."""
    return np.round(H.bonus(sliding_metrics(block.safe, block.length, block.m), weights, float, np.maximum), 9)[block.at]


def bonus_ranges(records: DataFrame, length: int) -> DataFrame:
    """(record_ord, low, mean, high) of the bonus over each record's windows."""

    def measure(block: Block, record: np.ndarray, many: int) -> list[np.ndarray]:
        bonus, low, high = bonuses(block), np.full(many, np.inf), np.full(many, -np.inf)
        np.minimum.at(low, record, bonus)
        np.maximum.at(high, record, bonus)
        return [np.bincount(record, minlength=many), low, np.bincount(record, bonus, many), high]

    found = _record_rows(records, length, "n bigint, low double, total double, high double", measure)
    return found.groupBy("record_ord").agg(F.min("low").alias("low"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("high").alias("high"))


def bonus_counts(records: DataFrame, length: int, thresholds: list[float]) -> DataFrame:
    """(n, t0, t1, ...): one row, how many windows there are and how many reach each bonus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(thresholds) + 1, np.int64)
        for batch in batches:
            for block in blocks(batch, length, 0):
                bonus = bonuses(block)
                counts += [len(bonus), *(np.count_nonzero(bonus >= t) for t in thresholds)]
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in counts], names=names)

    names = ["n", *(f"t{i}" for i in range(len(thresholds)))]
    counted = records.select("sequence").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def kmer_counts(records: DataFrame, size: int) -> DataFrame:
    """(kmer, n, records): how often each k-mer of residues stands, and in how many records (each row is one).
    Tasks count by number of k-mer, so that only their sums are shuffled; 14 letters at most."""
    if not 1 <= size <= 14:
        raise ValueError("k-mers have 1 to 14 letters")

    def merged(row: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((code, row))
        row, code, n = row[order], code[order], n[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)])
        return row[new], code[new], np.add.reduceat(n, new) if len(new) else n

    def summed(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        kinds, place = np.unique(code, return_inverse=True)
        digits = kinds[:, None] // 20 ** np.arange(size - 1, -1, -1) % 20
        names = [x.tobytes().decode() for x in _LETTERS[digits]]
        columns = [pa.array(names, pa.string()), pa.array(np.bincount(place, n, len(kinds)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(kinds)))]
        return pa.RecordBatch.from_arrays(columns, names=["kmer", "n", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = code = n = np.zeros(0, np.int64)  # of the last record, which the next block may go on with
            for block in blocks(batch, size, 0):
                number = np.zeros(block.m, np.int64)
                for i in range(size):
                    number = number * 20 + block.safe[i : i + block.m]
                found = block.row[np.searchsorted(block.base, block.at, side="right") - 1]
                row, code, n = merged(np.append(row, found), np.append(code, number[block.at]), np.append(n, np.ones(len(found), np.int64)))
                done = row < block.row[-1]
                yield summed(code[done], n[done])
                row, code, n = row[~done], code[~done], n[~done]
            yield summed(code, n)

    counted = records.select("sequence").mapInArrow(run, "kmer string, n bigint, records bigint")
    return counted.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
