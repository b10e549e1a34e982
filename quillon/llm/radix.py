"""Byte strings in one buffer: ordered by most-significant-digit passes, compared byte by byte, gathered.

A string is (start, length) in a buffer. Everything is exact; hashes only propose what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

DIGIT = 8


#: Bytes that are gathered at once; bounds the places that are held for it, eight bytes each.
GATHERED = 1 << 20


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strings of about GATHERED bytes together; a longer one is a range of its own."""
    sums, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + GATHERED, "right")))
        yield a, b
        a = b


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The strings' bytes, one after the other."""
    out, at = np.empty(int(lengths.sum()), data.dtype), 0
    for a, b in _blocks(lengths):
        ends = np.cumsum(lengths[a:b])
        size = int(ends[-1])
        out[at : at + size] = data[np.repeat(starts[a:b] - (ends - lengths[a:b]), lengths[a:b]) + np.arange(size)]
        at += size
    return out


class Digits:
    """The eight bytes from a position on, as a number whose order is theirs; zeros follow the end. No copy but of the buffer."""

    def __init__(self, data: np.ndarray):
        raw = np.zeros((len(data) // DIGIT + 2) * DIGIT, np.uint8)
        raw[: len(data)] = data
        count = len(raw) // DIGIT - 1
        self.views = [np.frombuffer(raw, ">u8", count, k) for k in range(DIGIT)]
        self.last = count * DIGIT - 1

    def at(self, positions: np.ndarray) -> np.ndarray:
        positions = np.minimum(positions, self.last)
        out, phase, place = np.empty(len(positions), np.uint64), positions & (DIGIT - 1), positions >> 3
        for k, view in enumerate(self.views):
            own = phase == k
            out[own] = view[place[own]]
        return out


def tied(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """For each string a number that equal strings share; -1 for a string without an equal.

    Digits of eight bytes, the most significant first: a pass orders each group by its next digit,
    which parts it into smaller groups, and strings that are alone drop out. After
    the last digit, lengths tell strings that end in zero bytes from shorter ones.
    within: strings of different numbers are different whatever their bytes.
    """
    out = np.full(len(starts), -1, np.int64)
    active = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64) if within is None else np.unique(within, return_inverse=True)[1]
    if not len(starts):
        return out
    digits = Digits(data)
    lengths = np.asarray(lengths, np.int64)
    depth, most = 0, int(lengths.max())
    while True:
        last = depth >= most
        if last:
            digit = lengths[active].astype(np.uint64)
        else:
            left = np.clip(lengths[active] - depth, 0, DIGIT)
            digit = digits.at(starts[active] + depth)
            short = left < DIGIT
            shift = ((DIGIT - left[short]) * 8).astype(np.uint64)
            kept = np.where(shift == 64, np.uint64(0), (digit[short] >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))
            digit[short] = kept
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, group = active[order[~alone]], (np.cumsum(new) - 1)[~alone]
        if last or not len(active):
            break
        depth += DIGIT
        most = int(lengths[active].max())
    out[active] = group
    return out


def classes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each string, a string of each class, each class's hash): equal strings by their hashes, compared byte by byte.

    Should two different strings have one hash, all strings get digests of their bytes instead.
    """
    kinds, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[of] != np.arange(len(of)))
    if len(again):
        like = first[of[again]]
        size = lengths[again]
        same = np.array_equal(size, lengths[like])
        if not (same and all(np.array_equal(gathered(data, starts[again[a:b]], size[a:b]), gathered(data, starts[like[a:b]], size[a:b])) for a, b in _blocks(size))):
            raw = data.tobytes()
            digests = [hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            _, first, of = np.unique(np.array(digests), return_index=True, return_inverse=True)
            kinds = np.frombuffer(b"".join(digests), "<u8")[::2][first]
    return of, first, kinds
