"""Words and five-word shingles of whole texts, hashed with numpy over Arrow buffers.

A word is a run of bytes other than space and the five ASCII control spaces; A-Z is lower-cased.
Both rules act on single ASCII bytes, so they can be applied to UTF-8 without decoding. Shingle
identity is a 64-bit hash; the hash of a word is a polynomial over its bytes, taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
SLICE_BYTES = 1 << 19
#: Rows of a slice: registers take as much memory for a short text as for a long one.
SLICE_ROWS = 1 << 10

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), bijective on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(_BASE, SLICE_BYTES + 1)
_BACK = _powers(_INVERSE, SLICE_BYTES + 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, and of at most ``rows`` rows; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n, first + (rows or n))
        yield first, last
        first = last


def gathered(index: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit ids of the entries ``index`` one after the other, and where each ends (n + 1)."""
    return spread(index, np.array([len(x) for x in ids], dtype=np.int64) // 4, np.frombuffer(b"".join(ids), dtype=np.int32))


def spread(index: np.ndarray, size: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, of entries that lie one after the other in ``table`` with ``size`` numbers each."""
    first = np.cumsum(size) - size
    each = size[index]
    ends = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(ends[-1], dtype=table.dtype)
    for k in range(0, len(index), 1 << 16):  # in parts, as places take twice the memory of ids
        part = slice(k, k + (1 << 16))
        a, b = ends[k], ends[min(k + (1 << 16), len(index))]
        out[a:b] = table[np.arange(a, b) + np.repeat(first[index[part]] - ends[:-1][part], each[part])]
    return out, ends


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, in order, and the index of the first word of each row (n + 1)."""
    low = _LOWER[raw[offsets[0] : offsets[-1]]]
    cuts = offsets - offsets[0]
    solid = ~_IS_SPACE[low]
    n = len(low)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    fresh = np.ones(n + 1, dtype=bool)
    fresh[1:n] = ~solid[:-1]
    fresh[cuts] = True
    starts = np.flatnonzero(solid & fresh[:n])
    stops = np.ones(n, dtype=bool)
    stops[:-1] = ~solid[1:] | fresh[1:n]
    ends = np.flatnonzero(solid & stops) + 1
    if n <= SLICE_BYTES:
        power, back = _POWER[:n], _BACK
    else:
        power, back = _powers(_BASE, n), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * power, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * back[starts])
    return words, np.searchsorted(starts, cuts)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, in order, and the index of the first shingle of each row (n + 1).

    A row with one to four words has one shingle, its whole sequence; a row without words has none.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    edges = np.zeros(len(bounds), np.int64)
    np.cumsum(sizes, out=edges[1:])
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], sizes) + np.repeat(bounds[:-1], sizes)
    if not len(at):
        return np.zeros(0, np.uint64), edges
    lengths = np.repeat(np.minimum(counts, WIDTH), sizes)
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        part = padded[at + k] * _PLACE[k]
        total += part if counts.min(initial=WIDTH) >= WIDTH else np.where(k < lengths, part, np.uint64(0))
    return mix(total + lengths.astype(np.uint64)), edges


def shingle_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, shingles, edges)`` for slices of a text column of bounded size."""
    raw, offsets = buffers(column)
    for first, last in slices(offsets, rows=SLICE_ROWS):
        words, bounds = word_hashes(raw, offsets[first : last + 1])
        shingles, edges = shingle_hashes(words, bounds)
        yield first, last, shingles, edges
