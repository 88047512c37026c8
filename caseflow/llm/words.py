"""Vectorised word scanning of a batch of UTF-8 texts (numpy, no per-word Python).

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``. These are ASCII, so
scanning bytes gives the same words as scanning characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice of texts handed to numpy at once; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1          # odd base of the rolling hash, so invertible mod 2**64
_R_INV = pow(_R, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n (mod 2**64), kept for the next slice."""
    if "r" not in _POWERS or len(_POWERS["r"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("r", _R), ("inv", _R_INV)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["r"], _POWERS["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all 64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about SLICE_BYTES; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return
    off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Words:
    """Words of one slice: byte starts and ends, the row of each, and the word range of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.append(False, solid)[:-1] & ~edge[:-1]     # a word byte of the same row stands before
        after = np.append(solid, False)[1:] & ~edge[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)     # words [first[i], first[i+1]) are row i's
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes, optionally after lower-casing A-Z."""
        return self.range_hashes(self.starts, self.ends, lower)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        r, inv = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * r[:len(data)], dtype=np.uint64, out=total[1:])
        h = (total[ends] - total[starts]) * inv[starts]
        return mix(h ^ (ends - starts).astype(np.uint64) * U64(_R))

    def windows(self, h: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every n-word window inside one row."""
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:len(h) - n + 1] == self.row[n - 1:])
        return at, self.chain(h, at, n)

    @staticmethod
    def chain(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = h[at]
        for k in range(1, n):
            out = mix(out * U64(_R) + h[at + k])
        return out
