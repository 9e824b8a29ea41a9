"""Words of whole Arrow batches as NumPy arrays: bounds, 64-bit hashes and shingles.

Everything here runs inside a task on one slice of a batch. Slices hold at most
``SLICE_BYTES`` of text or one document, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n`` (kept and regrown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n + n // 8)
        steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Slice:
    """Some documents of a batch. ``data`` holds their texts end to end."""

    first: int  # row of the batch that the slice starts at
    data: np.ndarray  # bytes, lower-cased if asked for
    bounds: np.ndarray  # byte offset of each document, and the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    words: np.ndarray  # number of the first word of each document, and the end
    hashes: np.ndarray  # of each word

    def __len__(self) -> int:
        return len(self.bounds) - 1


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, bounds


def slices(column: pa.Array, lower: bool, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of ``column`` in slices; words are runs of bytes other than 0x20 and 0x09-0x0D."""
    raw, bounds = _texts(column)
    n, row = len(column), 0
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        data = raw[bounds[row] : bounds[stop]]
        yield _slice(row, _LOWER[data] if lower else data, bounds[row : stop + 1] - bounds[row])
        row = stop


def runs(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every run of ``solid`` bytes, and the number of each document's first run."""
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    full = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][full], bounds[1:][full] - 1
    begins[heads] |= solid[heads]
    stops[tails] |= solid[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _slice(first: int, data: np.ndarray, bounds: np.ndarray) -> Slice:
    starts, ends, words = runs(~_BLANK[data], bounds)
    return Slice(first, data, bounds, starts, ends, words, byte_hashes(data, starts, ends))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range ``data[start:end]``."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MULTIPLIER, max(1, len(data)))[: len(data)], out=sums[1:])
    back = powers(_INVERSE, max(1, len(data)))
    h = (sums[ends] - sums[starts]) * (back[starts] if len(starts) else np.zeros(0, dtype=np.uint64))
    return mix(h + (ends - starts).astype(np.uint64))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each word sequence ``hashes[start:end]``; equal sequences get equal values anywhere."""
    base |= 1
    n = max(1, len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n)[: len(hashes)], out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one document's word hashes.

    With fewer than ``size`` words the whole sequence is the one shingle;
    without words the set is empty.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(size, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - width + 1 + k]
    return np.unique(mix(total))


def document_lines(column: pa.Array, shortest: int) -> Iterator[tuple[int, Iterator[tuple[bytes, bytes | None]]]]:
    """(row, lines) of every row; a line is (bytes as they are, key), the key None below ``shortest`` code points.

    Lines end at 0x0A; a key is stripped of 0x20 and 0x09-0x0D at both ends and lower-cased (A-Z).
    """
    for row, data, own in texts_of(column):
        cuts = np.flatnonzero(data == 10)
        starts, ends = np.sort(np.concatenate([own[:-1], cuts + 1])), np.sort(np.concatenate([cuts, own[1:]]))
        first = np.searchsorted(cuts, own) + np.arange(len(own))  # number of each document's first line
        solid = np.flatnonzero(~_BLANK[data])
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        full = a < b
        begin, end = starts.copy(), starts.copy()
        begin[full], end[full] = solid[a[full]], solid[b[full] - 1] + 1
        counts = points[end] - points[begin] >= max(shortest, 1)
        whole, lowered = data.tobytes(), _LOWER[data].tobytes()
        line = lambda k: (whole[starts[k] : ends[k]], lowered[begin[k] : end[k]] if counts[k] else None)
        for k in range(len(own) - 1):
            yield row + k, map(line, range(first[k], first[k + 1]))


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, byte offset of each text and the end) of slices of ``column``."""
    raw, bounds = _texts(column)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, raw[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def folded_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``texts_of`` with A-Z lower-cased."""
    for row, data, bounds in texts_of(column):
        yield row, _LOWER[data], bounds
