"""Word and word n-gram hashes of Arrow text columns, computed with numpy inside Spark tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. A word's hash is a polynomial over its
bytes modulo 2**64, taken from prefix sums, with a final mix; it does not depend on where the
word stands. Two different words or n-grams share a hash with a chance of about 2**-64 per pair.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.ones(256, bool)  # all but digits, letters and bytes of non-ASCII characters
_MARKS[48:58] = _MARKS[65:91] = _MARKS[97:123] = _MARKS[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at a time; bounds the working arrays, not the result.
BLOCK = 1 << 18


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
            self.up, self.down = grow(self.base), grow(self.inv)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Group:
    """Some consecutive documents of a batch: ``lo <= index < hi``; document lo + i has the words first[i] to first[i + 1]."""

    lo: int
    hi: int
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # first byte of each word in the column's buffer

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions (in ``hashes``) of all k-word windows inside one document, and their hashes."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORDS.upto(n)
        c = _sums(self.hashes * up)
        ends = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(n) + k <= ends)
        return at, mix((c[at + k] - c[at]) * down[at] + np.uint64(k))

    def docs(self) -> np.ndarray:
        """Document index within the group, for each word."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _hash_block(raw: np.ndarray, breaks: np.ndarray, lower: bool, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and hashes of the words of ``raw``; a word also ends at each of ``breaks``."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.ones(n + 1, bool)
    space = gaps[raw]
    edge[:-1] = space
    edge[breaks] = True
    solid = ~space
    opens = solid.copy()
    opens[1:] &= edge[1:n] | space[:-1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(solid & edge[1:]) + 1
    up, down = _BYTES.upto(n)
    c = _sums(((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * up)
    return starts, mix((c[ends] - c[starts]) * down[starts])


def groups(col: pa.Array, lower: bool = False, letters: bool = False) -> Iterator[Group]:
    """The words of a text column, some documents at a time; with ``letters`` words are runs of letters, digits and non-ASCII bytes.

    A document longer than ``BLOCK`` forms a group of its own and is hashed in blocks cut at white space.
    """
    raw, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
        hi = min(hi, n)
        a, b = int(off[lo]), int(off[hi])
        starts, hashes = [], []
        while a < b or not starts:
            e = b
            if hi == lo + 1 and b - a > BLOCK:  # move to the next white space
                e, step = a + BLOCK, 4096
                while e < b:
                    found = np.flatnonzero(_SPACE[raw[e : min(e + step, b)]])
                    if len(found):
                        e += int(found[0])
                        break
                    e, step = min(e + step, b), step * 2
            s, h = _hash_block(raw[a:e], off[lo : hi + 1][(off[lo : hi + 1] >= a) & (off[lo : hi + 1] <= e)] - a, lower, _MARKS if letters else _SPACE)
            starts.append(s + a)
            hashes.append(h)
            if e == b:
                break
            a = e
        s = starts[0] if len(starts) == 1 else np.concatenate(starts)
        h = hashes[0] if len(hashes) == 1 else np.concatenate(hashes)
        yield Group(lo, hi, h, np.searchsorted(s, off[lo : hi + 1]), s)
        lo = hi


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def word_shapes(raw: np.ndarray, off: np.ndarray, g: Group) -> np.ndarray:
    """Hash of each word's shape: capitals, small letters, digits and other characters, runs collapsed."""
    b = int(off[g.hi])
    out, starts = [np.zeros(0, np.uint64)], g.starts
    for i in range(0, len(starts), BLOCK // 4):
        x = int(starts[i])
        y = int(starts[i + BLOCK // 4]) if i + BLOCK // 4 < len(starts) else b
        kind = _CLASS[raw[x:y]]
        opens = np.zeros(y - x, bool)
        opens[starts[i : i + BLOCK // 4] - x] = True
        keep = opens.copy()
        keep[1:] |= kind[1:] != kind[:-1]
        keep &= ~_SPACE[raw[x:y]]
        kind, first = kind[keep], np.flatnonzero(opens[keep])
        up, down = _BYTES.upto(len(kind) + 1)
        c = _sums((kind.astype(np.uint64) + np.uint64(1)) * up[: len(kind)])
        out.append(mix((c[np.r_[first[1:], len(kind)]] - c[first]) * down[first]))
    return np.concatenate(out)
