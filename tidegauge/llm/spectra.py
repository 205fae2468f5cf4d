"""Eigendecompositions of scatter matrices that grow by one vector at a time.

A ``Spectrum`` holds the number, the exact sums and the scatter about the mean of some
vectors, the scatter as eigenvalues and eigenvectors. Adding a vector, or another spectrum,
changes the scatter by symmetric rank-one terms, and each is put into the decomposition by
solving its secular equation: with eigenvalues ``d`` and the term's vector ``z`` in the basis
of the eigenvectors, the new eigenvalues are the roots of ``1 + sum(z^2 / (d - x))``, one
between each two of ``d``. Components of ``z`` that vanish keep their eigenpair, and equal
eigenvalues are rotated until one of them alone meets the term (deflation); only the rest is
solved for. Eigenvectors come from the ``z`` for which the computed roots are exact, so they
stay orthogonal however close the roots are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
# Rounds of the root finder; it takes about six, and halves the interval where it strays.
ROUNDS = 60


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z2 / (d - x)) for rising ``d`` and positive ``z2``.

    Gives the roots and a matrix of ``d[i] - root[j]`` (row j), which is exact where root and
    eigenvalue nearly cancel: each root is found as the distance from its nearer end.
    """
    k = len(d)
    rows = np.arange(k)
    right = np.append(d[1:], d[-1] + z2.sum())
    width = right - d
    middle = d + width / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    near_left = at_middle >= 0
    near_left[-1] = True
    origin = np.where(near_left, d, right)
    gaps = d - origin[:, None]
    low = np.where(near_left, 0.0, -width / 2)
    high = np.where(near_left, np.where(at_middle >= 0, width / 2, width), 0.0)
    low[-1] = 0.0 if at_middle[-1] >= 0 else width[-1] / 2
    x = (low + high) / 2
    lower = rows[None, :] <= rows[:, None]
    for _ in range(ROUNDS):
        delta = gaps - x[:, None]
        terms = z2 / delta
        value = 1 + terms.sum(axis=1)
        slopes = terms / delta
        # Below the root the function is negative in each interval.
        low = np.where(value < 0, x, low)
        high = np.where(value > 0, x, high)
        psi = np.where(lower, slopes, 0.0).sum(axis=1)
        phi = slopes.sum(axis=1) - psi
        first = delta[rows, rows]
        second = np.append(delta[rows[:-1], rows[1:]], 1.0)
        # Two poles with the right value and slopes; above the last one there is no second.
        c = value - first * psi - np.where(rows < k - 1, second, 0.0) * phi
        a = (first + second) * value - first * second * (psi + phi)
        b = first * second * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = first[-1] + first[-1] * first[-1] * psi[-1] / c[-1]
        new = x + step
        astray = ~((new > low) & (new < high))
        new = np.where(astray, (low + high) / 2, new)
        settled = (np.abs(value) <= 4 * EPS * (1 + np.abs(terms).sum(axis=1))) | (np.abs(new - x) <= EPS * np.abs(new))
        x = np.where(settled, x, new)
        if settled.all():
            break
    return origin + x, gaps - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of the decomposed matrix plus v v'."""
    z = vectors.T @ v
    norm = float(z @ z)
    if norm == 0.0:
        return values, vectors
    small = 8 * EPS * max(float(values[-1]), norm)
    d = values
    # A component that vanishes leaves its pair alone.
    live = np.abs(z) * np.sqrt(norm) > small
    at = np.flatnonzero(live)
    # Of eigenvalues that are equal one takes the whole component, and the others stay.
    close = at[:-1][np.diff(d[at]) <= small] if len(at) > 1 else at[:0]
    if len(close):
        vectors, z, d = vectors.copy(), z.copy(), d.copy()
        following = dict(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        for i in close.tolist():
            j = following[i]
            r = float(np.hypot(z[i], z[j]))
            c, s = z[j] / r, z[i] / r
            z[i], z[j] = 0.0, r
            vectors[:, [i, j]] = np.column_stack([c * vectors[:, i] - s * vectors[:, j], s * vectors[:, i] + c * vectors[:, j]])
            live[i] = False
        at = np.flatnonzero(live)
    d, own = d.copy(), z[at]
    if not len(at):
        return values, vectors
    poles = d[at]
    roots, apart = secular_roots(poles, own * own)
    # z anew, from the roots: |d_i - root_j| over the distances of the poles, as ratios near 1.
    k = len(at)
    i, j = np.arange(k)[None, :], np.arange(k)[:, None]
    between = np.where(j < i, poles[None, :] - poles[:, None], 1.0)
    above = np.append(poles[1:], 0.0)[:, None] - poles[None, :]
    between = np.where((j >= i) & (j < k - 1), above, between)
    ratios = np.where(j < i, apart, -apart) / between
    fresh = np.sqrt(np.abs(ratios.prod(axis=0))) * np.sign(own)
    turned = fresh[None, :] / apart
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    vectors = vectors.copy() if not len(close) else vectors
    vectors[:, at] = vectors[:, at] @ turned.T
    d[at] = roots
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, sums and scatter (eigenvalues rising, eigenvectors as columns) of whole vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, np.int64), np.zeros(size), np.eye(size))

    def _put(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def _meet(self, n: int, sums: np.ndarray) -> None:
        """The term for the distance of two means, and the new number and sums."""
        if self.n:
            apart = sums / n - self.sums / self.n
            self._put(apart * np.sqrt(self.n / (self.n + n) * n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, x: np.ndarray) -> None:
        """One more vector: a term for its distance from the mean."""
        self._meet(1, x)

    def add_block(self, block: np.ndarray) -> None:
        """Many vectors. More than there are dimensions are turned into as many rows of the same
        scatter first (QR), and each row is a term; fewer are added one by one."""
        if len(block) <= 2 * len(self.sums):
            for x in block:
                self.add(x)
            return
        sums = block.sum(axis=0)
        for row in np.linalg.qr(block - sums / len(block), mode="r"):
            self._put(row)
        self._meet(len(block), sums)

    def merge(self, other: Spectrum) -> None:
        """Another spectrum: a term for each of its eigenpairs and one for the means."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._put(vector * np.sqrt(value))
        if other.n:
            self._meet(other.n, other.sums)
