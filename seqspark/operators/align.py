"""Alignment of a profile to a region with trimmed query ends and one skipped residue.

The alignments of a profile of n positions are a static plan (a few hundred rows). A task scores a batch of
regions against each row of the plan at once in numpy: an expression per alignment would multiply the size
of generated code. The best is the first of least score in the plan's order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.scoring import Profile, rescues, rigid_score


def plan(n: int, region: int, max_gaps: int = 1, least: int | None = None) -> list[tuple[int, int, int, int]]:
    """(q_start, q_end, t_start, gap) from 0, gap -1 without one, in the order that settles ties."""
    least = max(1, n - 1) if least is None else least
    if max_gaps not in (0, 1) or not 1 <= least <= n:
        raise ValueError("one gap at most, and from 1 to all positions aligned")
    out = []
    for qs in range(n):
        for qe in range(qs + least, n + 1):
            k = qe - qs
            out += [(qs, qe, t, -1) for t in range(region - k + 1)]
            if max_gaps:
                out += [(qs, qe, t, g) for t in range(region - k) for g in range(k + 1)]
    return out


def rescue_scores(codes: np.ndarray, table: np.ndarray, profile: Profile, context: dict[str, np.ndarray] | None = None, donors: np.ndarray | None = None) -> np.ndarray:
    """Scores of each position (rows: windows) with neighbour rescue, as the column expression gives them. donors
    (two planes of rows and places) takes the places of each position's first and second donor, -1 for none."""
    rows, n = codes.shape
    if donors is not None:
        donors[:] = -1
    direct = table[np.arange(n), codes]
    out = direct.copy()
    before, now = np.zeros(rows, bool), np.zeros(rows, bool)
    for i, p in enumerate(profile):
        suits = A.RESCUERS.get(p.residue, "")
        right_used = np.zeros(rows, bool)
        if suits:
            ok = np.array([x in suits for x in A.ALPHABET])
            near = []
            for j, free in ((i - 1, ~before), (i + 1, np.ones(rows, bool))):
                e = np.full(rows, np.nan)
                if 0 <= j < n:
                    e = table[i, codes[:, j]]
                    if context and p.charged and 0 < j < n - 1:
                        c = context[p.residue][codes[:, j - 1] * 400 + codes[:, j] * 20 + codes[:, j + 1]]
                        e = np.where(np.isnan(c), e, c)
                    e = np.where(~now & free & ok[codes[:, j]] & (e < direct[:, i]), e, np.nan)
                near.append(e)
            left, right = near
            has_l, has_r = ~np.isnan(left), ~np.isnan(right)
            first_l = has_l & (~has_r | (left <= right))
            e1 = np.where(first_l, left, np.where(has_r, right, direct[:, i]))
            two = np.zeros(rows, bool)
            if p.charged:
                e2 = np.fmax(left, right)
                mixed = np.maximum(e1 + A.SECOND_DONOR_WEIGHT * e2, A.SECOND_DONOR_CAP * e1)
                two = has_l & has_r & (e2 < 0) & (mixed < e1)
                e1 = np.where(two, mixed, e1)
            out[:, i] = e1
            right_used = (has_r & ~first_l) | (two & first_l)
            if donors is not None:
                one = np.where(first_l, i - 1, np.where(has_r, i + 1, -1))
                donors[0, :, i], donors[1, :, i] = one, np.where(two, 2 * i - one, -1)
        before, now = now, right_used
    return out


_CODE = np.full(256, -1, np.int64)
_CODE[list(A.ALPHABET.encode())] = range(20)


def _letters(texts: pa.Array | list[str], length: int) -> np.ndarray:
    """The bytes of texts of one length, a row each, from the column's buffer."""
    texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(texts), length)


def _codes(texts: pa.Array | list[str], length: int) -> np.ndarray:
    return _CODE[_letters(texts, length)]


def _sum(parts: np.ndarray) -> np.ndarray:
    """From left to right, as the column expressions add."""
    total = np.zeros(len(parts))
    for column in parts.T:
        total = total + column
    return total


def add_score(windows: DataFrame, profile: Profile, mode: str = "raw", floor: float = 1.0, rescue: str = "full", context=None, name: str = "score") -> DataFrame:
    """Adds the rigid score to valid windows. Plain sums are generated code; rescue runs in numpy over
    batches of windows, where the equal column expression (scoring.rescued) would be interpreted."""
    if not rescues(profile, rescue):
        return windows.withColumn(name, rigid_score(F.col("window"), profile, mode, floor, checked=True))
    table, known = np.array([p.scores(mode, floor) for p in profile]), {r: np.array(t) for r, t in (context or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("window"))
            score = _sum(rescue_scores(_codes(texts, len(profile)), table, profile, known)) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    return windows.mapInArrow(run, f"{types}, `{name}` double")


def aligned_columns(step: tuple[int, int, int, int]) -> list[int]:
    """The places of a region that an alignment of the plan scores."""
    qs, qe, ts, gap = step
    return [ts + x for x in range(qe - qs + (gap >= 0)) if x != gap]


def ease_ends(parts: np.ndarray, region: np.ndarray, sub: np.ndarray, cols: list[int], weight: float) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Position scores whose ends take a share of what the letters beside the alignment score lower, and
    (position, place of that letter, rows) of what they took. A single position takes the better side's."""
    k, width, moved = len(cols), region.shape[1], []
    if not weight > 0:
        return parts, moved
    sides = [(0, cols[0] - 1), (k - 1, cols[-1] + 1)]
    eased = [parts[:, i] for i, _ in sides]
    for side, (i, at) in enumerate(sides):
        if 0 <= at < width:
            f = sub[i, region[:, at]]
            lower = f < parts[:, i]
            eased[side] = np.where(lower, parts[:, i] + weight * (f - parts[:, i]), parts[:, i])
            moved.append((i, at, lower))
    if k == 1:
        left = eased[0] <= eased[1]
        moved = [(i, at, lower & (left if at < cols[0] else ~left)) for i, at, lower in moved]
        return np.minimum(*eased)[:, None], moved
    return np.column_stack([eased[0], parts[:, 1:-1], eased[1]]), moved


def align(region: np.ndarray, table: np.ndarray, profile: Profile, steps: list[tuple[int, int, int, int]], rescue: str = "full", gap_penalty: float = 0.0, flank_weight: float = 0.5, context=None) -> tuple[np.ndarray, np.ndarray]:
    """(best score, number of its alignment) for each row of codes; rows hold one region each, of one length."""
    rows = len(region)
    best, which = np.full(rows, np.inf), np.zeros(rows, np.int64)
    for number, step in enumerate(steps):
        qs, qe, _, gap = step
        cols = aligned_columns(step)
        codes, sub = region[:, cols], table[qs:qe]
        parts = sub[np.arange(qe - qs), codes] if rescue == "none" else rescue_scores(codes, sub, profile[qs:qe], context)
        total = _sum(ease_ends(parts, region, sub, cols, flank_weight)[0]) + (gap_penalty if gap >= 0 else 0.0)
        better = total < best
        best[better], which[better] = total[better], number
    return best, which


BREAKDOWN = "breakdown array<struct<position:int,label:string,energy:double>>, peripheral array<struct<position:int,target:bigint,residue:string,energy:double>>"


def add_breakdown(hits: DataFrame, profile: Profile, mode: str = "raw", floor: float = 1.0, rescue: str = "full", flank_weight: float = 0.5, context: dict[str, list[float]] | None = None) -> DataFrame:
    """Adds what makes up the scores of hits that ``semiglobal`` aligned: ``breakdown``, the label and energy
    of each aligned position of the query (donors' places count in aligned_window), and ``peripheral``, the
    letters beside the alignment that its ends took a share of, with their places in the record and what the
    position then scores. Only the alignment found is scored again, so hits by threshold may be many."""
    table, known = np.array([p.scores(mode, floor) for p in profile]), {r: np.array(t) for r, t in (context or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            qs, qe, begin, start = (column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("query_start", "query_end", "region_from", "target_start"))
            skip = column("skipped").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            region = column("region").to_pylist()
            keys = np.column_stack([qs - 1, qe, start - begin, np.where(skip > 0, skip - start, -1), [len(r) for r in region]]) if len(region) else np.zeros((0, 5), np.int64)
            breakdown, peripheral = [None] * len(region), [None] * len(region)
            kinds, place = np.unique(keys, axis=0, return_inverse=True)
            for kind, (*step, size) in enumerate(kinds.tolist()):
                rows = np.flatnonzero(place.ravel() == kind)
                codes, cols = _codes([region[r] for r in rows], size), aligned_columns(tuple(step))
                sub, k = table[step[0] : step[1]], step[1] - step[0]
                donors = np.full((2, len(rows), k), -1)
                parts = sub[np.arange(k), codes[:, cols]] if rescue == "none" else rescue_scores(codes[:, cols], sub, profile[step[0] : step[1]], known, donors)
                parts, moved = ease_ends(parts, codes, sub, cols, flank_weight)
                for x, r in enumerate(rows.tolist()):
                    letters = [region[r][c] for c in cols]
                    label = lambda i: letters[i] + "".join(f"{'<-' if plane == 0 else ','}{letters[j]}@{j + 1}" for plane in (0, 1) if (j := int(donors[plane, x, i])) >= 0)  # noqa: B023, E731
                    breakdown[r] = [{"position": step[0] + i + 1, "label": label(i), "energy": float(parts[x, i])} for i in range(k)]
                    peripheral[r] = [{"position": step[0] + i + 1, "target": int(begin[r]) + at, "residue": region[r][at], "energy": float(parts[x, i])} for i, at, took in moved if took[x]]
            kind = lambda **f: pa.list_(pa.struct(list(f.items())))
            extra = [
                pa.array(breakdown, kind(position=pa.int32(), label=pa.string(), energy=pa.float64())),
                pa.array(peripheral, kind(position=pa.int32(), target=pa.int64(), residue=pa.string(), energy=pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "breakdown", "peripheral"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    return hits.mapInArrow(run, f"{types}, {BREAKDOWN}")


def aligner(
    profile: Profile, mode: str = "raw", floor: float = 1.0, rescue: str = "full", max_gaps: int = 1, least: int | None = None,
    gap_penalty: float = 0.0, flank_weight: float = 0.5, context: dict[str, list[float]] | None = None,
):
    """A function of batches with region and region_from, that adds the columns of ADDED."""
    if not 0 <= flank_weight <= 1:
        raise ValueError("the flank weight is between 0 and 1")
    n, table = len(profile), np.array([p.scores(mode, floor) for p in profile])
    known = {r: np.array(t) for r, t in (context or {}).items()}
    plans = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("region"))
        region = texts.to_pylist()  # for the letters of the alignment that is found
        at = batch.column(batch.schema.get_field_index("region_from")).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(r) for r in region], np.int64)
        score, found = np.zeros(len(region)), np.zeros((len(region), 4), np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            steps = plans.setdefault(int(size), plan(n, int(size), max_gaps, least))
            # Equal regions of a batch are aligned once.
            distinct, place = np.unique(_letters(texts.take(pa.array(rows)), int(size)).view(f"S{size}")[:, 0], return_inverse=True)
            codes = _CODE[distinct.view(np.uint8).reshape(len(distinct), int(size))]
            each = [align(codes[lo : lo + 4096], table, profile, steps, rescue, gap_penalty, flank_weight, known) for lo in range(0, len(codes), 4096)]
            score[rows] = np.concatenate([x for x, _ in each])[place]
            found[rows] = np.array(steps)[np.concatenate([x for _, x in each])[place]]
        qs, qe, ts, gap = found.T
        end = ts + (qe - qs) + (gap >= 0)
        aligned = [r[t:e] if g < 0 else r[t : t + g] + r[t + g + 1 : e] for r, t, e, g in zip(region, ts, end, gap)]
        extra = [score, qs + 1, qe, at + ts, at + end - 1]
        skipped = pa.array([int(a + t + g) if g >= 0 else None for a, t, g in zip(at, ts, gap)], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra), skipped, pa.array(aligned, pa.string())], names=[*batch.schema.names, *_ADDED])

    return run


def semiglobal(windows: DataFrame, profile: Profile, *args, **options) -> DataFrame:
    """Adds score, query_start, query_end, target_start, target_end, skipped and aligned_window to windows
    with a region (see windows(flank=...)); rows whose region has other letters go. Options as ``aligner``'s."""
    add = aligner(profile, *args, **options)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    return windows.filter("region is not null").mapInArrow(lambda batches: map(add, batches), f"{types}, {ADDED}")


_ADDED = ("score", "query_start", "query_end", "target_start", "target_end", "skipped", "aligned_window")
ADDED = "score double, query_start bigint, query_end bigint, target_start bigint, target_end bigint, skipped bigint, aligned_window string"
