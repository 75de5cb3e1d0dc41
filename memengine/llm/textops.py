"""Vectorised byte and word arithmetic for the Arrow batches of this subpackage.

Everything here works on the buffers of one Arrow batch: UTF-8 bytes, document
offsets, word spans and 64-bit word hashes.  No per-word Python objects are
made.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def give_back() -> None:
    """Return freed memory to the system, and the tables of powers: a Python worker lives on after its task, beside those of other tasks."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For a second hash of the same words, independent of the first: both together have 128 bits.
_MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_CODES2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept until give_back()."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes each (a longer row alone); all rows are covered."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of several texts: spans, offsets per text and hashes.

    `separator` is a table of 256 booleans over bytes: a word is a longest run
    of bytes outside it.  `table` maps bytes first (lower-casing, say).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, table: np.ndarray | None = None):
        self.data = data if table is None else table[data]
        n = len(data)
        gap = np.ones(n + 1, dtype=bool)
        np.take(separator, self.data, out=gap[:n])
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        start = np.empty(n + 1, dtype=bool)
        start[0] = True
        start[1:] = gap[:-1] | first[1:]
        start &= ~gap
        self.starts = np.flatnonzero(start)
        end = (gap[1:] | first[1:]) & ~gap[:-1]
        self.ends = np.flatnonzero(end) + 1
        #: words of text i are self.of[i] .. self.of[i + 1]
        self.of = np.searchsorted(self.starts, offsets)

    def hashes(self, second: bool = False) -> np.ndarray:
        """One 64-bit hash for each word, from its bytes alone; or a second, independent one."""
        n = len(self.data)
        codes, mult = (_BYTE_CODES2, int(_MULT2)) if second else (_BYTE_CODES, int(_MULT))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[self.data] * _powers(mult, n), out=sums[1:])
        back = _powers(_inverse(mult), n + 1)
        return mix((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive hashes; the result is k - 1 shorter (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x1234567 + salt, dtype=np.uint64)
    mult = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) & (2**64 - 1))
    for j in range(k):
        out *= mult
        out += hashes[j : j + n]
    return mix(out)


def inside(of: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the positions 0 .. total - k start a run of k words that stays in one text."""
    n = max(0, total - k + 1)
    ok = np.zeros(n + k, dtype=np.int32)
    counts = np.diff(of)
    has = counts >= k
    np.add.at(ok, of[:-1][has], 1)
    np.add.at(ok, (of[1:] - k + 1)[has], -1)
    return np.cumsum(ok)[:n] > 0


def text_of(offsets_of_words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text number of each word position."""
    return np.searchsorted(offsets_of_words, positions, side="right") - 1
