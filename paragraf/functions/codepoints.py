"""Whole Arrow columns of text as one array of code points: classes, words and rolling hashes without per-row Python."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters worked on at once; a longer single text is taken alone.
SLICE_CHARS = 1_000_000
#: Base of the polynomial hash: odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: The Unicode version that classes and lower case come from; it travels with the tasks.
UNICODE = unicodedata.unidata_version


def same_unicode(version: str) -> None:
    """Raise where this Python's Unicode version is another than the driver's: words would differ from task to task."""
    if unicodedata.unidata_version != version:
        raise RuntimeError(f"Unicode {unicodedata.unidata_version} here, {version} on the driver")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter or digit (classes L and N), and its lower case where that is one code point."""
    size = sys.maxunicode + 1
    word, lower = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for cp in range(size):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            word[cp] = True
        low = ch.lower()
        if low != ch and len(low) == 1:
            lower[cp] = ord(low)
    return word, lower


def is_word(cps: np.ndarray) -> np.ndarray:
    return _tables()[0][cps]


def lowered(cps: np.ndarray) -> np.ndarray:
    return _tables()[1][cps]


def is_blank(cps: np.ndarray) -> np.ndarray:
    """Space, tab, line feed, carriage return and no-break space."""
    return (cps == 32) | (cps == 9) | (cps == 10) | (cps == 13) | (cps == 160)


def slices(column: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, offset of each row and the end) for runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < len(column):
        end = int(np.searchsorted(off, off[row] + chars, "right")) - 1
        end = min(max(end, row + 1), len(column))
        part = bytes(raw[off[row] : off[end]])
        lead = (np.frombuffer(part, np.uint8) & 0xC0) != 0x80
        before = np.zeros(len(part) + 1, np.int64)
        np.cumsum(lead, out=before[1:])
        cps = np.frombuffer(part.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield row, end, cps, before[off[row : end + 1] - off[row]]
        row = end


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i before each place; span_hash takes any span's hash from them."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], out=total[1:])
    return total


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the values in [start, end), the same wherever the span lies."""
    inverse = powers(len(total))[1]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of letters and digits; a run ends where its row ends."""
    inside = np.zeros(len(cps) + 1, bool)
    inside[:-1] = is_word(cps)
    first = np.zeros(len(cps) + 1, bool)
    first[rows] = True
    before = np.zeros(len(cps) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first))
    end = np.flatnonzero(before & (~inside | first))
    return start, end, np.searchsorted(rows, start, "right") - 1


def shingle_table(cps: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): for each row the sorted distinct hashes of its runs of `width` consecutive lower-cased words, one row
    after another; bounds are where each row begins and the end."""
    start, end, row = word_spans(cps, rows)
    n = len(rows) - 1
    if len(start) < width:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = span_hash(prefix_hash(lowered(cps)), start, end)
    last = len(words) - width + 1
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(3) + words[k : k + last])
    whole = row[:last] == row[width - 1 :]
    h, row = h[whole], row[:last][whole]
    bounds = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[once], np.searchsorted(row[once], np.arange(n + 1))


def shingle_sets(cps: np.ndarray, rows: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `width` consecutive lower-cased words."""
    h, bounds = shingle_table(cps, rows, width)
    return [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
