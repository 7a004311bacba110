"""Words and shingles of many texts at once, as arrays over the bytes of an Arrow column.

A word is a run of bytes other than space, \\t, \\n, \\x0b, \\x0c and \\r. Words and sequences of words
are compared by 64-bit hashes of their bytes; two independent ones are used together where a
hash alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one for a seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mixed(np.arange(256, dtype=np.uint64), 77)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        if len(have) <= 4 * RUN_BYTES:
            _powers[int(base)] = have
    return have


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) for runs of rows; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row (one more than rows)."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SEPARATOR[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[1:-1][cuts]  # a word never runs from one text into the next
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word; ``lower`` takes A-Z for a-z."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[lower][data] * _power(_STEP, len(data) + 1)[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _power(_BACK, len(data) + 1)[starts], 1) + (ends - starts).astype(np.uint64)


def sequences(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from every place on (across texts too; the caller leaves those out)."""
    n = max(0, len(hashes) - length + 1)
    total = np.zeros(n, np.uint64)
    factor = np.uint64((0x2545F4914F6CDD1D + 2 * seed * 0x9E3779B9) | 1)
    with np.errstate(over="ignore"):
        for i in range(length):
            total = total * factor + hashes[i : i + n]
    return mixed(total, 100 + seed)


def shingles(data: np.ndarray, offsets: np.ndarray, length: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hashes) of every row, sorted within it, and the number before each row.

    A row with fewer words than ``length`` has its whole sequence as one; a row without words none.
    """
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower)
    counts = np.diff(before)
    grams = sequences(hashes, length)
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - before[rows]
    full = place + length <= counts[rows]
    at = np.flatnonzero(full)
    row, gram = rows[at], grams[at]
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        extra = np.array([sequences(hashes[before[r] : before[r + 1]], counts[r])[0] for r in short], np.uint64)
        row, gram = np.concatenate([row, short]), np.concatenate([gram, mixed(extra, 7)])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[fresh], gram[fresh]
    return gram, np.searchsorted(row, np.arange(len(counts) + 1))
