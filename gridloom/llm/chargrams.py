"""Hashed character n-grams of whole texts, as array operations over code points, and linear training on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
GROUP = 1 << 18


def groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, bounds) of stretches of rows, lower-cased; a blank stands before and after each text."""
    i = 0
    while i < len(texts):
        some, size, j = [], 0, i
        while j < len(texts) and (not some or size + len(texts[j] or "") <= GROUP):
            some.append(f" {texts[j].lower()} " if texts[j] else "  ")
            size += len(some[-1])
            j += 1
        yield i, np.frombuffer("".join(some).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, some)])
        i = j


def grams(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The feature of the n-gram at each place, also of those that run over a text's end (see ``inside``)."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = (cp[:m] + np.uint32(n)) * _M[0]
    for j in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _M[j] + cp[j : j + m] * _M[5]
    h ^= h >> np.uint32(13)
    h *= _M[3]
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def inside(bounds: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of m places begin an n-gram within one text."""
    ok = np.ones(m, bool)
    for j in range(1, n):
        at = bounds[1:] - j
        at = at[(at >= 0) & (at < m)]
        ok[at] = False
    return ok


class Rows:
    """Sparse rows: indices and values, with the row of each entry."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, width: int):
        self.row, self.col, self.val, self.n, self.width = row, col, val, n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], minlength=self.width)

    def some(self, keep: np.ndarray) -> Rows:
        to = np.cumsum(keep) - 1
        e = keep[self.row]
        return Rows(to[self.row[e]], self.col[e], self.val[e], int(keep.sum()), self.width)


def fit(x: Rows, y: np.ndarray, loss: str, penalty: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear model by accelerated gradient steps. y: +1 or -1. loss: ``logistic`` or ``hinge`` (squared hinge, an SVM)."""
    n, w, b = max(1, x.n), np.zeros(x.width), 0.0
    v = np.ones(x.width) / np.sqrt(x.width)
    for _ in range(12):  # largest singular value, for the step
        v = x.tdot(x.dot(v))
        scale = np.linalg.norm(v)
        v = v / scale if scale else v
    curve = 0.25 if loss == "logistic" else 2.0
    step = 1 / (curve * (scale / n * 1.1 + 1) + penalty)
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = w + (t - 1) / nt * (w - pw), b + (t - 1) / nt * (b - pb)
        m = y * (x.dot(zw) + zb)
        g = -y / (1 + np.exp(np.clip(m, -50, 50))) if loss == "logistic" else -2 * y * np.maximum(0, 1 - m)
        pw, pb = w, b
        w, b, t = zw - step * (x.tdot(g) / n + penalty * zw), zb - step * g.mean(), nt
    return w, float(b)


def fit_rows(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], scale: np.ndarray, penalty: float, rounds: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """A logistic model over rows of places with one value for each place, by limited-memory BFGS.

    blocks: places of some rows one after the other, how many each row has, and labels +1 or -1. Work is done a block at a time.
    """
    n, width = max(1, sum(len(y) for _, _, y in blocks)), len(scale)

    def loss(w):
        v, total, slope = w[:width] * scale, 0.0, np.zeros(width + 1)
        for col, lengths, y in blocks:
            sums, some = np.zeros(len(y)), lengths > 0
            if len(col):
                sums[some] = np.add.reduceat(v[col], (np.cumsum(lengths) - lengths)[some])
            m = y * (sums + w[width])
            g = -y / (1 + np.exp(np.clip(m, -50, 50)))
            slope[:width] += np.bincount(col, np.repeat(g, lengths), minlength=width)
            slope[width] += g.sum()
            total += float(np.logaddexp(0, -m).sum())
        slope /= n
        slope[:width] = slope[:width] * scale + penalty * w[:width]
        return total / n + penalty / 2 * (w[:width] @ w[:width]), slope

    w = np.zeros(width + 1)
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-6:
            break
        d, alphas = -g, []
        for s, t, r in reversed(steps):
            a = r * (s @ d)
            alphas.append(a)
            d = d - a * t
        if steps:
            s, t, r = steps[-1]
            d = d / (r * (t @ t))
        for (s, t, r), a in zip(steps, reversed(alphas), strict=True):
            d = d + s * (a - r * (t @ d))
        size, down = (1.0 if steps else min(1.0, 1 / np.abs(g).sum())), g @ d
        for _ in range(20):
            nw = w + size * d
            nf, ng = loss(nw)
            if nf <= f + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, t = nw - w, ng - g
        if s @ t > 1e-12:
            steps = [*steps[-memory + 1 :], (s, t, 1 / (s @ t))]
        done = f - nf < 1e-7 * max(1.0, abs(f))
        w, f, g = nw, nf, ng
        if done:
            break
    return w[:width], float(w[width])
