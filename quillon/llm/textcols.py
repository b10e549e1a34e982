"""Vectorised text helpers that run inside Spark tasks on Arrow batches.

A batch of texts is seen as one byte buffer with row offsets, so that splitting
into words and hashing them costs a few numpy passes instead of a Python loop.
Nulls count as empty texts. Nothing here touches the driver or keeps state
beyond small tables of powers.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from inspect import getfullargspec

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; bounds temporaries and tables of powers to some MB.
SLICE_BYTES = 1 << 18

#: Words of more bytes have a cryptographic hash: a polynomial modulo 2**64 gives long words of certain patterns the same one.
LONG_WORD = 16

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MULT_W = 0xD1342543DE82EF95
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_MULT_2 = 0xA0761D6478BD642F
_BYTE_CODES_2 = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64)
_tables: dict[int, np.ndarray] = {}

#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NON_WORD = np.zeros(256, bool)
NON_WORD[list(range(0x30)) + list(range(0x3A, 0x61)) + list(range(0x7B, 0x80))] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(mult: int, n: int) -> np.ndarray:
    """The first n powers of mult modulo 2**64; grown once and then shared."""
    have = _tables.get(mult)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), mult, _U)
        have[0] = 1
        np.cumprod(have, out=have)
        _tables[mult] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over the whole word (in place)."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int = _MULT) -> np.ndarray:
    """Hash of codes[s:e] for each pair, equal for equal runs wherever they lie."""
    n = len(codes)
    sums = np.zeros(n + 1, _U)
    np.cumsum(codes * powers(mult, n), out=sums[1:])
    inverse = pow(mult, -1, 1 << 64)
    out = (sums[ends] - sums[starts]) * powers(inverse, n + 1)[starts]
    out += (ends - starts).astype(_U) * _U(0x632BE59BD9B4E019)
    return mix(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, validity) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    valid = np.asarray(column.is_valid())
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("" if kind == pa.large_string() else b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer single row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    inside = ~separators[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    stops = inside
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, rows_of(starts, offsets)


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each byte position (ascending)."""
    counts = np.diff(np.searchsorted(positions, offsets, side="left"))
    return np.repeat(np.arange(len(offsets) - 1), counts)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False):
    """(hash, start, end, row) of every word."""
    h, _, starts, ends, rows = _hashed(data, offsets, separators, lower, 1)
    return h, starts, ends, rows


def word_hashes_twice(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False):
    """(hash, a second hash that does not follow from the first, row) of every word: 128 bits that tell words apart."""
    h, h2, _, _, rows = _hashed(data, offsets, separators, lower, 2)
    return h, h2, rows


def _hashed(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool, times: int):
    if lower:
        data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, separators)
    h = run_hashes(_BYTE_CODES[data], starts, ends)
    h2 = run_hashes(_BYTE_CODES_2[data], starts, ends, _MULT_2) if times > 1 else None
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        both = np.frombuffer(b"".join(digests), _U).reshape(-1, 2)
        h[long] = both[:, 0]
        if h2 is not None:
            h2[long] = both[:, 1]
    return h, h2, starts, ends, rows


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words, by its first word; rows are not looked at."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    at = np.arange(n)
    return run_hashes(words, at, at + width, _MULT_W)


def byte_window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    at = np.arange(n)
    return run_hashes(_BYTE_CODES[data], at, at + width, _MULT)


def same_row(rows: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` entries: does it stay within one row?"""
    n = len(rows) - width + 1
    return rows[:n] == rows[width - 1 :] if n > 0 else np.zeros(0, bool)


def cover(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Entries of n that lie in a flagged window of `width`, windows given by their starts."""
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:-1]) > 0


def tidy() -> None:
    """Gives freed memory back to the system: workers stay alive between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """f for groups of one to three arguments, then tidy()."""

    def one(a):
        return _after(f, a)

    def two(a, b):
        return _after(f, a, b)

    def three(a, b, c):
        return _after(f, a, b, c)

    return (one, two, three)[len(getfullargspec(f).args) - 1]


def _after(f: Callable, *args):
    out = f(*args)
    tidy()
    return out


def tidied_batches(f: Callable) -> Callable:
    """f for an iterator of batches, then tidy()."""

    def run(batches):
        yield from f(batches)
        tidy()

    return run
