"""Isolation forests over a table's normal rows, with an acceptable range at every node.

Features are coded into ``BINS`` equal steps over three times the range of the rows the forest is grown on.  A
node also knows the range its own rows allow (their range, widened by itself on either side); a row outside it
is isolated there.  So rows unlike all normal ones have short paths even where they are many.

Every tree is grown on all rows.  A node needs only the counts of its rows by bin, and counts of parts add up, so
rows may lie anywhere.  Sizes count in units of n / ``psi`` rows, and a node's range leaves out at either end the
share by which the range of so many units falls short: paths and ranges do not grow with the number of rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

TREES, PSI, BINS = 16, 64, 64
#: Rows the forest is grown on lie in the middle third of the bins: the first of them, and how many there are.
FIRST, WIDTH = 20, 24


class Forest(NamedTuple):
    low: np.ndarray  # least acceptable value of each feature
    step: np.ndarray  # width of a bin of each feature
    feat: np.ndarray  # tested feature, by tree and node
    cutoff: np.ndarray  # first bin of the right child, by tree and node
    least: np.ndarray  # acceptable bins
    most: np.ndarray
    length: np.ndarray  # path length of each leaf, NaN at inner nodes
    norm: float


def _c(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649) - 2 * (n - 1) / big, np.where(n == 2, 1.0, 0.0))


@lru_cache(maxsize=PSI)
def _paths(psi: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of up to psi rows and their mean path lengths."""
    return np.arange(psi + 1), _c(np.arange(psi + 1))


@lru_cache(maxsize=PSI)
def _chance(f: int, depth: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Tested feature and random number of each tree and node."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    # each tree tests the features in turn, each of f trees from another one on, so that no feature is left to chance
    turns = np.concatenate([rng.permutation(f) for _ in range(-(-trees // f))])
    level = np.floor(np.log2(np.arange(nodes) + 1)).astype(np.int64)
    tree = np.arange(trees)[:, None]
    return turns[np.minimum(tree // f * f, len(turns) - f) + (tree + level) % f].astype(np.int16), rng.random((trees, nodes))


def _bins(low: np.ndarray, step: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bins 1 to BINS - 2 inside the acceptable range, 0 below and BINS - 1 above."""
    return np.clip(np.floor((x - low) / step) + 1, 0, BINS - 1).astype(np.uint8)


class Grower:
    """A forest grown two levels at a time from the counts of its rows."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, n: int, *, trees: int = TREES, psi: int = PSI, seed: int = 7):
        """lo, hi: least and greatest value of each feature of the n rows."""
        lo, hi = np.asarray(lo, np.float64), np.asarray(hi, np.float64)
        wide = np.where(hi > lo, hi - lo, 1e-9 * np.maximum(np.abs(hi), 1e-3))
        self.low, self.step = lo - wide, 3 * wide / (BINS - 2)
        self.n, self.psi, self.level = n, min(psi, n), 0
        self.depth = max(1, int(np.ceil(np.log2(max(self.psi, 2)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feat, self.r = _chance(len(lo), self.depth, trees, seed)
        self.cutoff, self.least, self.most = np.zeros((trees, nodes), np.int16), np.zeros((trees, nodes), np.int16), np.full((trees, nodes), BINS - 1, np.int16)
        self.length = np.full((trees, nodes), np.nan)

    def code(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows the forest is grown on, by feature and row."""
        return np.ascontiguousarray(np.clip(_bins(self.low, self.step, x), FIRST, FIRST + WIDTH - 1).T)

    def count(self, code: np.ndarray) -> np.ndarray:
        """Rows by tree, node of this level, and bins of the features that this level and the next test."""
        trees, nodes = self.feat.shape
        at = np.zeros((trees, code.shape[1]), np.int32)
        for k in range(self.level):
            a = 2**k - 1
            cut = self.cutoff.ravel().take(at + (np.arange(trees, dtype=np.int32) * nodes + a)[:, None])
            at = 2 * at + (code[self.feat[:, a]] >= cut)
        at += (np.arange(trees, dtype=np.int32) << self.level)[:, None]
        for k in range(self.level, min(self.level + 2, self.depth)):
            at = at * WIDTH + (code[self.feat[:, 2**k - 1]] - FIRST)
        return np.bincount(at.ravel(), minlength=self.places)

    @property
    def places(self) -> int:
        return (len(self.feat) << self.level) * WIDTH ** min(2, self.depth - self.level)

    def split(self, count: np.ndarray) -> None:
        """Grow the levels of ``count``, summed over all parts."""
        trees = len(self.feat)
        if self.level + 1 < self.depth:
            both = count.reshape(trees, -1, WIDTH, WIDTH)
            left = self._split(both.sum(axis=3))
            left = np.einsum("tna,tnab->tnb", left.astype(np.int64), both)
            by = np.stack([left, both.sum(axis=2) - left], axis=2).reshape(trees, -1, WIDTH)
        else:
            by = count.reshape(trees, -1, WIDTH)
        left = (self._split(by) * by).sum(axis=2)
        if self.level == self.depth:
            size = np.stack([left, by.sum(axis=2) - left], axis=2).reshape(trees, -1)
            own = self.length[:, 2**self.level - 1 :]
            own[:] = np.where(np.isnan(own), self.level + self._path(size), own)

    def _path(self, size: np.ndarray) -> np.ndarray:
        return np.interp(size * (self.psi / self.n), *_paths(self.psi))

    def _split(self, by: np.ndarray) -> np.ndarray:
        """Cut the nodes of a level by their rows' bins; the bins that go left."""
        a, z = 2**self.level - 1, 2 ** (self.level + 1) - 1
        upto, own = by.cumsum(axis=2), self.length[:, a:z]
        size = upto[:, :, -1]
        # where the ends of as many rows as psi rows would leave here are to be expected
        end = np.maximum(size / (size * (self.psi / self.n) + 1), 0.5)
        lo = np.where(size > 0, FIRST + (upto < end[:, :, None]).sum(axis=2), BINS)
        hi = np.where(size > 0, FIRST + (upto <= (size - end)[:, :, None]).sum(axis=2), -1)
        room = np.maximum(hi - lo, 1)
        some = (size > 0) & np.isnan(own)
        self.least[:, a:z] = np.where(some, np.maximum(lo - room, 1), 0)
        self.most[:, a:z] = np.where(some, np.minimum(hi + room, BINS - 2), BINS - 1)
        own[:] = np.where(np.isnan(own) & ((size * self.psi <= self.n) | (hi <= lo)), self.level + self._path(size), own)
        cutoff = self.cutoff[:, a:z] = np.where(hi > lo, lo + 1 + np.floor(self.r[:, a:z] * (hi - lo)), 0)
        self.length[:, 2 * a + 1 : 2 * z + 1 : 2] = own
        self.length[:, 2 * a + 2 : 2 * z + 2 : 2] = own
        self.level += 1
        return np.arange(FIRST, FIRST + WIDTH) < cutoff[:, :, None]

    @property
    def done(self) -> bool:
        return self.level == self.depth

    def forest(self) -> Forest:
        return Forest(self.low, self.step, self.feat, self.cutoff, self.least, self.most, self.length, float(max(_c(self.psi), 1.0)))


def grow(x: np.ndarray) -> Forest:
    """A forest of all rows of x."""
    g = Grower(x.min(axis=0), x.max(axis=0), len(x))
    code = g.code(x)
    while not g.done:
        g.split(g.count(code))
    return g.forest()


def _walk(forest: Forest) -> np.ndarray:
    """Next place, times BINS, by tree, place and bin; a place beyond the nodes is where rows end that a level isolates."""
    trees, nodes = forest.feat.shape
    depth = int(np.log2(nodes + 1)) - 1
    inner, places = 2**depth - 1, nodes + depth
    at, b = np.arange(inner, dtype=np.int16)[:, None], np.arange(BINS, dtype=np.int16)
    level = np.floor(np.log2(at + 1)).astype(np.int16)
    to = np.empty((trees, places, BINS), np.int16)
    to[:, inner:] = np.arange(inner, places, dtype=np.int16)[:, None]
    np.add(2 * at + np.int16(1), b >= forest.cutoff[:, :inner, None], out=to[:, :inner])
    out = (b < forest.least[:, :inner, None]) | (b > forest.most[:, :inner, None])
    np.copyto(to[:, :inner], nodes + level, where=out)
    return (to + (np.arange(trees, dtype=np.int32) * places)[:, None, None]) * np.int32(BINS)


def score(forest: Forest, x: np.ndarray, *, chunk: int = 2048) -> np.ndarray:
    """Isolation score of each row, near 1 for rows cut off early or outside the acceptable ranges."""
    trees, nodes = forest.feat.shape
    depth = int(np.log2(nodes + 1)) - 1
    n, f = x.shape
    to = _walk(forest).ravel()
    feat = np.pad(forest.feat, ((0, 0), (0, depth))).astype(np.int32).ravel()
    length = np.concatenate([forest.length, np.tile(np.arange(depth), (trees, 1))], axis=1).ravel()
    root = (np.arange(trees, dtype=np.int32) * (nodes + depth))[:, None]
    total = np.empty(n)
    for a in range(0, n, chunk):
        code = _bins(forest.low, forest.step, x[a : a + chunk]).ravel()
        row = np.arange(0, len(code), f, dtype=np.int32)
        at = to.take(root * BINS + code.take(feat.take(root) + row))
        for _ in range(depth - 1):
            at = to.take(at + code.take(feat.take(at // BINS) + row))
        total[a : a + chunk] = length.take(at // BINS).sum(axis=0)
    return 2.0 ** (-total / trees / forest.norm)
