"""Words and hashes of Arrow text columns, in numpy over the raw UTF-8 buffers; no per-word Python objects.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so multi-byte characters stay whole.  A word's hash
is a polynomial over a random byte table modulo 2**64, taken from prefix sums, then finalised; it depends on the
word alone and is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_GEN = np.random.Generator(np.random.PCG64(20240517))
_TABLE = _GEN.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_UPPER = np.arange(256)
_UPPER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers by which the words of a window are combined.
STEP = _GEN.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
STEP2 = _GEN.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SECOND = _GEN.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        out = np.ones(size, dtype=np.uint64)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * U64(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column; a null is an empty text.  A text is never split."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off_buf, data = column.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offs, offs[first] + max_bytes, "right")) - 1
        end = min(len(column), max(first + 1, end))
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    space = SPACE[buf]
    solid = ~space
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = space[:-1]
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span; ``lower`` maps A-Z to a-z first, ``second`` takes an independent byte table."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    n = len(buf)
    table = _SECOND if second else _TABLE
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((table[_UPPER] if lower else table)[buf] * powers(_BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts])


def windows(h: np.ndarray, text: np.ndarray, size: int, step: np.ndarray = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word number of each window of ``size`` words that lies in one text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = h[:n] * step[0]
    for k in range(1, size):
        total += h[k : k + n] * step[k]
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(total[at]), at
