"""Vectorised text kernels (numpy) for operators that work in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words and their white space are told apart on UTF-8 bytes: all white space here is ASCII.
SHINGLE = 5
#: Bytes of text that are worked on at once; one longer text is worked on by itself.
CHUNK_BYTES = 1 << 20

_OLD = np.seterr(over="ignore")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit constants."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUES = constants(256, 11)
MULTIPLIER = 0x5851F42D4C957F2D
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (or more) powers of the multiplier and of its inverse mod 2^64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (MULTIPLIER, _INVERSE):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(base)
            out.append(np.cumprod(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


class Prefix:
    """Hashes of any substrings of one byte array, by a polynomial mod 2^64."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of 5-word shingles of each text as a sorted array of distinct 64-bit
    hashes. A-Z are lower-cased; a text of one to four words is one shingle; a text
    without words gives an empty array."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > CHUNK_BYTES:
            yield from _sets(group)
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield from _sets(group)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8).copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words = Prefix(data).hash(starts, ends)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    factors = constants(SHINGLE, 23) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        whole += words[k : k + len(whole)] * factors[k]
    whole = mix64(whole)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= SHINGLE:
            yield np.unique(whole[a : b - SHINGLE + 1])
        elif b > a:
            yield mix64((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield whole[:0]
