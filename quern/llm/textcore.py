"""Byte-level text kernels shared by the corpus operators.

All separators of the operators' word rules are ASCII, so words can be cut on UTF-8
bytes without decoding. The kernels work on whole Arrow batches in slices of a bounded
number of bytes and return numpy arrays; a word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once (a longer text is handled alone).
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`: what ends a word of white-space separated text.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: words of 0-9, a-z and non-ASCII characters.
NON_WORD = np.zeros(256, bool)
NON_WORD[0x00:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) and the inverses, modulo 2**64."""
    global _up, _down
    if len(_up) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _up, _down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _up[:n], _down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls as empty texts) and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most so many bytes, or of one row."""
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


class Words:
    """The words of the texts of one slice: byte spans, hashes, and the first word of each text."""

    __slots__ = ("bytes", "ends", "first", "hash", "starts")

    def __init__(self, data: np.ndarray, off: np.ndarray, ends_word: np.ndarray, lower: bool = True):
        base, n = int(off[0]), int(off[-1] - off[0])
        off = off - base
        d = data[base : base + n]
        d = LOWER[d] if lower else d
        inside = ~ends_word[d]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.bytes = d
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, off)
        up, down = _powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[d] * up[:n], out=run[1:])
        self.hash = mix((run[self.ends] - run[self.starts]) * down[self.starts])

    def text(self, word: int) -> str:
        return self.bytes[self.starts[word] : self.ends[word]].tobytes().decode("utf-8", "replace")


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive word hashes that begin at each place; the last k-1 places have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _GRAM
        g += h[j : j + n]
    return mix(g ^ np.uint64(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; a shorter text counts as one shingle."""
    g, out = grams(words.hash, k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        else:
            out.append(grams(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
