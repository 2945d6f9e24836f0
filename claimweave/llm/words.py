"""Words of a batch of texts as arrays: places, documents and 64-bit hashes, computed on the UTF-8 bytes.

Words are maximal runs of bytes other than space and \\x09-\\x0D. Those bytes never occur inside a
multi-byte character, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
SLICE_BYTES = 2 << 20
BASE = _U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64's finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * BASE)


_BYTE = stream(256, 1)
_MULT = stream(1, 2)[0] | _U(1)
_INVERSE = _U(pow(int(_MULT), -1, 1 << 64))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, factor in enumerate((_MULT, _INVERSE)):
            values = np.full(size, factor, _U)
            values[0] = 1
            _POWERS[k] = np.multiply.accumulate(values)
    return _POWERS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and the n + 1 places where texts begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    at = text_bytes(batch.column(text))[1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges are in order and do not overlap. Works in blocks of bounded size."""
    out = np.empty(len(starts), _U)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")), first + 1)
            low, high = int(starts[first]), int(ends[last - 1])
            power, inverse = _powers(high - low + 1)
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=sums[1:])
            s, e = starts[first:last] - low, ends[first:last] - low
            out[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U) * BASE)
            first = last
    return out


@dataclass
class Words:
    """Words of n texts; ``doc`` is the text's number, ``bounds`` the n + 1 places where texts' words begin."""

    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)


def words_of(column: pa.Array, lower: bool = True) -> Words:
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    begins = solid[1:-1] & ~solid[:-2]
    finishes = solid[1:-1] & ~solid[2:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[edges] |= solid[1:-1][edges]
    finishes[edges - 1] |= solid[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    bounds = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    return Words(data, at, starts, ends, doc, bounds)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every window of k words; a text of 1 to k - 1 words has one shingle, all of them."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        counts = words.counts
        width = np.minimum(counts, k)
        left = words.bounds[1:][words.doc] - np.arange(n)  # words from here to the text's end
        value = np.zeros(n, _U)
        for i in range(k):
            part = np.zeros(n, _U)
            if i < n:
                part[: n - i] = hashes[i:]
            part[left <= i] = 0
            value = value * BASE + part
        whole = left >= width[words.doc]
        return words.doc[whole], mix(value[whole] + width[words.doc[whole]].astype(_U))


def distinct_sets(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of n documents, one after the other, and the n + 1 places where they begin."""
    at = np.searchsorted(doc, np.arange(n + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    sizes = np.fromiter(map(len, sets), np.int64, n)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(sizes)])


def line_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, number in the text, first byte, end) of all lines between line feeds; every text has one at least."""
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, at)) + 1
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    inner = np.ones(len(owner), bool)
    inner[first] = False
    start = np.empty(len(owner), np.int64)
    start[first], start[inner] = at[:-1], breaks + 1
    end = np.empty(len(owner), np.int64)
    end[first + count - 1], end[np.flatnonzero(inner) - 1] = at[1:], breaks
    return owner, np.arange(len(owner)) - first[owner], start, end
