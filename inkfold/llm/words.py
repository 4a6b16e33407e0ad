"""Vectorised word kernel: words, word hashes and rolling hashes of whole Arrow text columns.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; on UTF-8 this equals the same class over code points. Hashes are
64-bit polynomial sums over randomised bytes (modulo 2**64), finished by a mixer. Everything works on the column's own
buffers, without one Python object per text or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, so that two workers fit beside a small heap; a longer text makes a
#: slice of its own, or comes in pieces.
SLICE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: White space by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inverse(a: int) -> int:
    return pow(a, -1, 2**64)


#: Powers that a process keeps; sums are taken in stretches of about so many places.
STRETCH = 1 << 19


class _Powers:
    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, np.uint64(_inverse(int(base)))
        self.up = self.down = np.ones(1, np.uint64)

    def _made(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        both = []
        for b in (self.base, self.inv):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        return both[0], both[1]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least n powers of the base and of its inverse; more than a stretch are not kept."""
        if n > 2 * STRETCH:
            return self._made(n)
        if len(self.up) < n:
            self.up, self.down = self._made(min(max(n, 2 * len(self.up), 1 << 16), 2 * STRETCH))
        return self.up, self.down


_P1, _P2 = _Powers(_R1), _Powers(_R2)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n+1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _edges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a stretch of bytes at a time."""
    starts, ends = [], []
    before = False
    for a in range(0, len(data), 4 * STRETCH):
        solid = ~SPACE[data[a : a + 4 * STRETCH]]
        prev = np.concatenate([[before], solid[:-1]])
        cut = np.zeros(len(solid), bool)
        cut[off[(off >= a) & (off < a + len(solid))] - a] = True
        starts.append(np.flatnonzero(solid & (~prev | cut)) + a)
        ends.append(np.flatnonzero(prev & (~solid | cut)) + a)
        before = bool(solid[-1])
    if before:
        ends.append(np.array([len(data)]))
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Words:
    """The words of some texts: byte places of each, and of which text they are."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False) -> None:
        self.data = _LOWER[data] if lower else data
        self.off = off
        self.start, self.end = _edges(self.data, off)
        #: word numbers at which each text begins, n+1 of them
        self.word_off = np.searchsorted(self.start, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return lane(self.data, self.start, self.end, _BYTE)

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def lane(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, in order and apart, from random numbers for the bytes; worked out piece by piece."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STRETCH, "right")))
        a, e = int(start[i]), int(end[j - 1])
        up, down = _P1.get(e - a + 1)
        sums = np.zeros(e - a + 1, np.uint64)
        np.cumsum(table[data[a:e]] * up[: e - a], out=sums[1:])
        out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) * _R2))


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each stretch, as two numbers."""
    return lane(data, start, end, _BYTE), lane(data, start, end, _BYTE2)


def runs(h: np.ndarray, word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k words in a row that lie in one text, and n+1 offsets into them; texts of fewer words have none."""
    per = np.maximum(np.diff(word_off) - k + 1, 0)
    off = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=off[1:])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    out = np.empty(off[-1], np.uint64)
    at = np.arange(off[-1]) + np.repeat(word_off[:-1] - off[:-1], per)
    i = 0
    while i < len(at):  # a stretch of words at a time
        j = max(i + 1, int(np.searchsorted(at, at[i] + STRETCH - k, "right")))
        a, e = int(at[i]), int(at[j - 1]) + k
        up, down = _P2.get(e - a + 1)
        sums = np.zeros(e - a + 1, np.uint64)
        np.cumsum(h[a:e] * up[: e - a], out=sums[1:])
        here = at[i:j] - a
        out[i:j] = (sums[here + k] - sums[here]) * down[here]
        i = j
    return mix(out), off


@dataclass
class Piece:
    """Word hashes of some whole texts, or of a part of one long text."""

    first: int  # row of the first text
    end: int
    h: np.ndarray
    word_off: np.ndarray
    base: int  # words of the text before h[0]
    fresh: int  # words that no earlier piece had
    size: int  # bytes


def hashed(col: pa.Array, overlap: int, lower: bool = False, most: int | None = None) -> Iterator[Piece]:
    """Word hashes of a text column, slice by slice. A text longer than a slice comes in pieces, each of which begins with the
    last ``overlap`` words of the one before: runs of one more word than that are each in exactly one piece."""
    most = most or SLICE_BYTES
    data, off = text_buffers(col)
    for i, j in slices(off, most):
        part = data[off[i] : off[j]]
        if len(part) <= most:
            w = Words(part, off[i : j + 1] - off[i], lower)
            yield Piece(i, j, w.hashes(), w.word_off, 0, len(w.start), len(part))
            continue
        kept, seen = np.zeros(0, np.uint64), 0
        for a, e in stretches(part, most):
            w = Words(part[a:e], np.array([0, e - a]), lower)
            h = np.concatenate([kept, w.hashes()])
            yield Piece(i, j, h, np.array([0, len(h)]), seen - len(kept), len(w.start), e - a)
            seen += len(w.start)
            kept = h[max(0, len(h) - overlap) :] if overlap else h[:0]


def stretches(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about so many bytes of a text that end at white space or at its end."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            stop = np.flatnonzero(SPACE[data[end : end + most]])
            end = end + int(stop[0]) if len(stop) else min(end + most, len(data))
            if len(stop):
                break
        yield at, end
        at = end


def joined(data: np.ndarray) -> Iterator[bytes]:
    """The words of a text joined by one space, in pieces of bounded size."""
    some = False
    for a, e in stretches(data, SLICE_BYTES):
        words = data[a:e].tobytes().split()
        if words:
            yield (b" " if some else b"") + b" ".join(words)
            some = True


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most so many bytes together, or one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def worded(col: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """The words of a text column, slice by slice: (first row, end row, words)."""
    data, off = text_buffers(col)
    for i, j in slices(off, most):
        yield i, j, Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower)
