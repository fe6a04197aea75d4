"""Words of many texts at once, as numpy arrays: where they stand and a 64-bit hash of each.

A block of texts is one byte array; prefix sums of byte * r**position (mod 2**64) give the hash of any stretch from two
lookups, so no Python object is made for a word. `check` is a second, independent hash of the same stretches.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers, any will do.
_R = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def class_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


SPACE = class_of(b" \t\n\x0b\x0c\r")


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a multiplier and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size, r = 1 << max(20, (n - 1).bit_length()), _R[which]
        _POWERS[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x % 2**64, np.uint64)]), dtype=np.uint64) for x in (r, pow(r, -1, 2**64)))
    return _POWERS[which]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Block:
    """texts: bytes each. word i: data[starts[i]:ends[i]]; words of text k: range(first[k], first[k + 1])."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        self.data = b"\n".join([*texts, b""])
        self.bytes = np.frombuffer(self.data, np.uint8)
        gap = np.concatenate([[True], separators[self.bytes], [True]])
        at = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))])
        gap[at[1:]] = True  # the joint ends a word in any case
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends, self.texts_at = edge[::2], edge[1::2], at
        self._sums: dict[int, np.ndarray] = {}

    @property
    def first(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.texts_at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        up, down = _powers(len(self.bytes) + 1, which)
        if which not in self._sums:
            self._sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], dtype=np.uint64)])
        sums = self._sums[which]
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def blocks(texts: Iterable[bytes], size: int = 500_000) -> Iterator[list[bytes]]:
    """texts in lists of about `size` bytes; a longer text is a list of its own."""
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def windows(h: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text: (index of its first word, hash)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(n + 1, which)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    at = np.arange(n - k + 1)
    ends = np.repeat(first[1:], np.diff(first))  # of the text that each word is in
    at = at[at + k <= ends[: n - k + 1]]
    return at, mixed((sums[at + k] - sums[at]) * down[at])


_table: list = []


def _give_back() -> None:
    """Hand freed memory back to the system: allocators keep what an earlier stage used, and workers serve many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def worker_table(key, make):
    """make(), kept by this Python worker until another key is asked for: workers serve many stages, and each holds one large table at a time."""
    if not _table or _table[0] != key:
        _table.clear()
        _give_back()
        _table.extend((key, make()))
    return _table[1]


class Lookup:
    """Sorted hash array: a growing map from 64-bit hashes to codes 0, 1, 2, ... in order of arrival."""

    def __init__(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Codes of sorted or unsorted hashes; -1: not there."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.codes[at], -1)

    def add(self, h: np.ndarray) -> None:
        """h: sorted, none of them there yet."""
        at = np.searchsorted(self.keys, h)
        new = np.arange(len(self.keys), len(self.keys) + len(h))
        self.keys, self.codes = np.insert(self.keys, at, h), np.insert(self.codes, at, new)
