"""Vectorised word kernels over Arrow string buffers.

Words are maximal runs of non-separator bytes of UTF-8 text. A word's 64-bit hash comes from prefix sums of a
polynomial, so a chunk of text costs a handful of NumPy passes and no Python object per word. Windows of words are
multilinear hashes of the word hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R = U(0x9E3779B97F4A7C15 | 5)  # odd, 5 modulo 8
SEGMENT = 1 << 18
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def multipliers(k: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U) * U(0xD1342543DE82EF95) + U(seed * 7919 + 17)) | U(1)


@functools.cache
def lut(kind: str) -> np.ndarray:
    """64-bit value of each byte, 0 for separators. kinds: space, space_lower, alnum_lower."""
    v = mix(np.arange(256, dtype=U) + U(0xA0761D6478BD642F)) | U(1)
    b = np.arange(256)
    if kind.endswith("lower"):
        v[65:91] = v[97:123]
    if kind.startswith("space"):
        off = (b == 32) | ((b >= 9) & (b <= 13))
    else:  # words of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
        off = ~(((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128))
    v[off] = 0
    return v


_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        with np.errstate(over="ignore"):
            inv = _R
            for _ in range(6):  # Newton's iteration for the inverse modulo 2**64
                inv = inv * (U(2) - _R * inv)
            for name, r in (("p", _R), ("i", inv)):
                a = np.full(n, r, U)
                a[0] = 1
                _pow[name] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each (one row at least)."""
    _, o = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of some documents in order: hash, doc (index), start and end (bytes), first (index of a doc's first word)."""

    __slots__ = ("hash", "doc", "start", "end", "first", "count")

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: str):
        table = lut(kind)
        ndoc = len(offs) - 1
        hs, ss, es = [], [], []
        at, n = 0, len(data)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        while at < n:
            to = min(n, at + SEGMENT)
            while to < n and not edge[to] and table[data[to - 1]] != 0:  # cut behind a separator or at a document's end
                step = data[to : to + 4096]
                stop = np.flatnonzero((table[step] == 0) | edge[to : to + len(step)])
                to = to + int(stop[0]) + (0 if edge[to + int(stop[0])] else 1) if len(stop) else to + len(step)
                to = min(to, n)
            v = table[data[at:to]]
            m = to - at
            p, inv = _powers(max(m, SEGMENT))
            word = v != 0
            st, en = word.copy(), word.copy()
            st[1:] &= ~word[:-1] | edge[at + 1 : to]
            en[:-1] &= ~word[1:] | edge[at + 1 : to]
            s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
            c = np.zeros(m + 1, U)
            np.cumsum(v * p[:m], out=c[1:])
            hs.append(mix((c[e] - c[s]) * inv[s] + (e - s).astype(U)))
            ss.append(s + at)
            es.append(e + at)
            at = to
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash, self.start, self.end = cat(hs, U), cat(ss, np.int64), cat(es, np.int64)
        bounds = np.searchsorted(self.start, offs)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(ndoc), self.count)

    def position(self) -> np.ndarray:
        return np.arange(len(self.doc)) - self.first[self.doc]


def windows(h: np.ndarray, doc: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, and whether it lies within one document; the arrays are k-1 shorter than h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    m = multipliers(k, seed)
    out = h[:n] * m[0]
    for j in range(1, k):
        out += h[j : j + n] * m[j]
    return mix(out), doc[:n] == doc[k - 1 :]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def words_of(col: pa.Array, kind: str) -> Words:
    return Words(*buffers(col), kind)
