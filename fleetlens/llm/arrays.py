"""Whole-array text work inside a task: words, shingles and span hashes of Arrow text columns with numpy.

Every hash depends on bytes alone, so tasks, retries and runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes worked on at once; one longer text is a piece of its own.
PIECE = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mixed(mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)))


BYTE_VALUES = seeded(256, 11)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept for pieces of the usual size."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, PIECE) + 1, base & ((1 << 64) - 1), U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have


class Spans:
    """64-bit hashes of any byte span of a buffer, from one running sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUES[buf] * powers(BASE, n)[:n], out=self.sums[1:])
        self.inverse = powers(BASE_INVERSE, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def text_buffers(column: pa.Array, lower: bool = False, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them) of consecutive rows, about ``limit`` bytes at a time.

    Null is the empty text.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, last, data[offsets[row]: offsets[last]], offsets[row: last + 1] - offsets[row]
        row = last


#: Blanks, control characters and ASCII punctuation; what is left are digits, letters and all of UTF-8 beyond ASCII.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes not in ``between``, never across rows, and the first word of each row (rows + 1)."""
    n = len(buf)
    solid = ~between[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each row (rows + 1)."""
    start, end, first = word_spans(buf, offsets)
    return Spans(buf)(start, end), first


SHINGLE_FACTORS = seeded(64, 23) | U64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a row and the first of each row; a shorter row with words has one."""
    counts = np.diff(first)
    n = len(words)
    if n >= width:
        sums = words[: n - width + 1] * SHINGLE_FACTORS[0]
        for j in range(1, width):
            sums = sums + words[j: n - width + 1 + j] * SHINGLE_FACTORS[j]
        sums = mixed(sums)
    else:
        sums = np.zeros(0, U64)
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(first[:-1], counts)
    whole = place <= np.repeat(counts, counts) - width
    short = np.flatnonzero((counts > 0) & (counts < width))
    hashes, owner = sums[np.flatnonzero(whole)], rows[whole]
    if len(short):
        own = np.array([mixed(np.add.reduce(words[first[r]: first[r + 1]] * SHINGLE_FACTORS[8: 8 + counts[r]], keepdims=True))[0]
                        for r in short], U64)
        at = np.searchsorted(owner, short)
        hashes, owner = np.insert(hashes, at, own), np.insert(owner, at, short)
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed 64-bit integers that Spark has."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
