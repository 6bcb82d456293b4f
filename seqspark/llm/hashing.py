"""Words and Rabin-Karp hashes of whole Arrow columns of text, all in numpy: no Python object per word.

Hashes are 64-bit polynomials modulo 2**64 of bytes (words) and of mixed word hashes (windows)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTE, _BYTE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
WINDOW_BASE = 0xD6E8FEB86659FD93
_SOME = 1 << 21  # bytes of text taken at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); null texts are empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(at) else np.zeros(1, np.int64)


def text_slices(batch: pa.RecordBatch, column: int, times: int = 1) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with some MB of text, or so many times that."""
    sizes = np.cumsum(np.diff(text_buffer(batch.column(column))[1]))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + times * _SOME)) + 1
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte + 1, text number, hash) of each word. ends: as text_buffer gives it."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none.astype(np.uint64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # a text ends a word
    before = np.append(False, inside[:-1]) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False) & ~edge[1:]
    stops = np.flatnonzero(inside & ~after) + 1
    h = np.empty(len(starts), np.uint64)
    block = 1 << 16  # of words: powers of positions within a block only
    for lo in range(0, len(starts), block):
        a, b = starts[lo : lo + block], stops[lo : lo + block]
        base = a[0]
        part = data[base : b[-1]].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers(_BYTE, len(part)), dtype=np.uint64)])
        h[lo : lo + block] = (total[b - base] - total[a - base]) * powers(_BYTE_INVERSE, len(part) + 1)[a - base]
    doc = np.searchsorted(ends, starts, side="right") - 1
    return starts, stops, doc, mix(h + (stops - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, size: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Rabin-Karp hashes of all windows of so many words (mixed); windows over text ends too."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, have, double, wide = None, 0, h, 1
    left = size
    while True:  # window of `have` words times base**wide, plus the next `wide` words
        if left & 1:
            out = double if out is None else out[: len(double) - have] * np.uint64(pow(base, wide, 2**64)) + double[have:] if have else double
            have += wide
        left >>= 1
        if not left:
            break
        double = double[:-wide] * np.uint64(pow(base, wide, 2**64)) + double[wide:]
        wide *= 2
    return mix(out[: len(h) - size + 1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of so many."""
    reach = 1
    while reach < size:
        step = min(reach, size - reach)
        x = np.minimum(x[:-step], x[step:])
        reach += step
    return x
