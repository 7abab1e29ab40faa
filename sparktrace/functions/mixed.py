"""Distances of mixed points (cells, num) to a few centroids, worked out by numpy for a batch at a time.

The same numbers as the expressions give: whole edits per cell, squares added up in the order of the features, rounded half to even.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

# (cell, centroid) entries that are added up at once.
ENTRIES = 4_000_000
# Cells and values are numbered by a table up to this size, beyond it by sorting.
NUMBERED = 1 << 20


@lru_cache(maxsize=100_000)
def edits(a: int, b: int) -> int:
    """Levenshtein distance of two whole numbers as texts."""
    left, right = str(a), str(b)
    row = list(range(len(right) + 1))
    for i, x in enumerate(left, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(right, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@dataclass(frozen=True)
class Batch:
    """Points as arrays. Equal (pos, n) cells share a ``code``, a row of ``pos`` and ``n``."""

    begin: np.ndarray  # where each point's codes begin; one more at the end
    code: np.ndarray
    pos: np.ndarray
    n: np.ndarray
    num: np.ndarray  # NaN where there is none
    lacks: np.ndarray  # numbers that there are none of
    unknown: np.ndarray  # points without a map of cells

    @classmethod
    def of(cls, cells: pa.MapArray, num: pa.ListArray, dims: int) -> Batch:
        offsets = cells.offsets.to_numpy().astype(np.int64)
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        keys = cells.keys.slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.int64)
        values = cells.items.slice(low, high - low).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        code, pos, n = _numbered(keys, values)
        table, lacks = cls.numbers(num, dims), np.ones((len(num), dims), dtype=bool)
        told = np.flatnonzero(~num.is_null().to_numpy(zero_copy_only=False))
        lacks[told] = num.flatten().is_null().to_numpy(zero_copy_only=False).reshape(len(told), dims)
        return cls(offsets - low, code, pos, n, table, lacks, cells.is_null().to_numpy(zero_copy_only=False))

    @staticmethod
    def numbers(num: pa.ListArray, dims: int) -> np.ndarray:
        """The numbers as a table, NaN where there is none."""
        table = np.full((len(num), dims), np.nan)
        told = np.flatnonzero(~num.is_null().to_numpy(zero_copy_only=False))
        table[told] = num.flatten().to_numpy(zero_copy_only=False).reshape(len(told), dims)
        return table

    def sums(self, per_code: np.ndarray) -> np.ndarray:
        """Per point the sum of its codes' rows."""
        width, made = per_code.shape[1], np.zeros((len(self.begin) - 1, per_code.shape[1]), dtype=per_code.dtype)
        step = max(1, ENTRIES // max(1, len(self.code)))
        full = np.flatnonzero(np.diff(self.begin))
        for at in range(0, width, step) if len(full) else ():
            made[full, at : at + step] = np.add.reduceat(per_code[:, at : at + step][self.code], self.begin[full], axis=0)
        return made


def _numbered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of every (key, value), and the keys and values of the numbers."""
    if not len(keys):
        return keys, keys, values
    (lo, hi), (least, most) = ((int(x.min()), int(x.max())) for x in (keys, values))
    wide = most - least + 1
    if (hi - lo + 1) * wide <= NUMBERED:
        joined = (keys - lo) * wide + values - least
        seen = np.flatnonzero(np.bincount(joined))
        number = np.zeros((hi - lo + 1) * wide, dtype=np.int64)
        number[seen] = np.arange(len(seen))
        return number[joined], seen // wide + lo, seen % wide + least
    some, key_at = np.unique(keys, return_inverse=True)
    others, value_at = np.unique(values, return_inverse=True)
    seen, code = np.unique(key_at * len(others) + value_at, return_inverse=True)
    return code, some[seen // len(others)], others[seen % len(others)]


class Centers:
    """Centroids, each given by its non-zero cells and its numbers."""

    def __init__(self, cells: list[dict[int, int]], num: list[list[float | None]], dims: int):
        self.count, self.dims = len(cells), dims
        self.with_cell: dict[int, list[tuple[int, int]]] = {}
        for i, some in enumerate(cells):
            for pos, n in some.items():
                self.with_cell.setdefault(pos, []).append((i, n or 0))
        self.alone = np.array([sum(edits(0, n or 0) for n in some.values()) for some in cells], dtype=np.int64)
        self.num = np.array([[np.nan if x is None else x for x in some[:dims]] for some in num], dtype=np.float64).reshape(self.count, dims)
        self.lacks = np.array([any(x is None for x in some[:dims]) for some in num], dtype=bool)

    def distances(self, batch: Batch, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance of every point and centroid, and where there is none."""
        per_code = np.empty((len(batch.pos), self.count), dtype=np.int32)
        for row, (pos, n) in enumerate(zip(batch.pos.tolist(), batch.n.tolist())):
            per_code[row] = edits(n, 0)
            for i, other in self.with_cell.get(pos, ()):
                per_code[row, i] = edits(n, other) - edits(0, other)
        squares = np.zeros((len(batch.num), self.count))
        for i in range(self.dims):
            apart = batch.num[:, i, None] - self.num[None, :, i]
            squares += apart * apart
        dist = np.rint((batch.sums(per_code) + self.alone + np.sqrt(squares)) * float(10**digits)) / float(10**digits) + 0.0
        return dist, (batch.unknown | batch.lacks.any(axis=1))[:, None] | self.lacks[None, :]


def nearest(dist: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Column of the smallest distance of every row, the first of equal ones; a missing distance comes before all, NaN after all."""
    return np.argmin(np.where(none, -1.0, np.where(np.isnan(dist), np.inf, dist)), axis=1)
