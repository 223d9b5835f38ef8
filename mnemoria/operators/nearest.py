"""Helpers inside tasks: the best rows of each query among the vectors that a task sees.

Matrix products say which pairs can matter, within a margin for their rounding.
Those are scored in the order of ``functions.vector``'s sums, so a score is the
same double as that of the column expression, wherever its row was read.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Vectors and queries of one matrix product.
ROWS, ASKED = 2048, 1024
#: Pairs that wait for a sort.
WAITING = 400_000


def _in_order(products: np.ndarray) -> np.ndarray:
    total = np.zeros(len(products))
    for column in products.T:
        total += column
    return total


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_in_order(x * x))


def scores(kind: str, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Scores of rows of ``a`` with those of ``b``, as the column expressions give them; ``na`` and ``nb``: their norms."""
    if kind == "l2":
        return _in_order((a - b) * (a - b))
    dots = _in_order(a * b)
    if kind == "dot":
        return dots
    n = na * nb
    out = np.where(n > 0, dots / np.where(n > 0, n, 1.0), 0.0)
    return np.clip(out, 0.0, 1.0) if kind == "clamped" else out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest decimal form, as SQL rounds."""
    scale = 10.0**digits
    out = np.rint(x * scale) / scale
    for i in np.flatnonzero(np.abs(np.abs(x * scale) % 1.0 - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Best:
    """The ``k`` best (greatest ``good``, then least id) of each query so far, with one number of payload."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.waiting = 0

    def add(self, q: np.ndarray, good: np.ndarray, ids: np.ndarray, load: np.ndarray) -> None:
        self.held.append((q, good, ids, load))
        self.waiting += len(q)
        if self.waiting > max(WAITING, len(self.least) * self.k):
            self.sort()

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, good, ids, load = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -good, q))
        q, good, ids, load = q[order], good[order], ids[order], load[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], good[full])
        own = place < self.k
        self.held, self.waiting = [(q[own], good[own], ids[own], load[own])], 0
        return self.held[0]


def pairs(kind: str, x: np.ndarray, asked: np.ndarray, k: int, least: np.ndarray, sign: int = 1, digits: int | None = None, floor: float | None = None, which: np.ndarray | None = None, rows: np.ndarray | None = None):
    """Yields (queries, rows, scores) that may be among the k best; ``least``: a bound of each query's k-th that this raises."""
    na, nx = norms(asked), norms(x)
    which = np.arange(len(asked)) if which is None else which
    rows = np.arange(len(x)) if rows is None else rows
    unit = lambda m, n: m / np.where(n > 0, n, 1.0)[:, None]
    own, other = (x, asked) if kind in ("dot", "l2") else (unit(x, nx), unit(asked, na))
    step = 0.0 if digits is None else 10.0**-digits
    for i in range(0, len(rows), ROWS):
        v = rows[i : i + ROWS]
        for j in range(0, len(which), ASKED):
            q = which[j : j + ASKED]
            about = own[v] @ other[q].T
            margin = np.full(len(q), step + 1e-12)
            if kind == "clamped":
                np.clip(about, 0.0, 1.0, out=about)
            elif kind == "dot":
                margin = step + 1e-12 * na[q] * nx[v].max()
            elif kind == "l2":
                about = na[q][None, :] ** 2 + nx[v][:, None] ** 2 - 2 * about
                margin = step + 1e-12 * (na[q] + nx[v].max()) ** 2
            if sign < 0:
                about = -about
            new = np.flatnonzero(np.isneginf(least[q])) if len(v) >= k else []
            if len(new):
                kth = -np.partition(-about[:, new], k - 1, axis=0)[k - 1]
                least[q[new]] = kth - margin[new]
            cut = least[q] - margin
            if floor is not None and sign > 0:
                cut = np.maximum(cut, floor - margin)
            at, to = np.nonzero(about >= cut[None, :])
            if not len(at):
                continue
            vi, qi = v[at], q[to]
            score = scores(kind, x[vi], nx[vi], asked[qi], na[qi])
            if digits is not None:
                score = rounded(score, digits)
            keep = sign * score >= least[qi]
            if floor is not None:
                keep &= score >= floor
            yield qi[keep], vi[keep], score[keep]
