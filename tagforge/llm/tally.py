"""Counts of rows of 64-bit numbers inside a task, merged whenever they grow."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .wordhash import U64, mix


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one with the sum of their counts, those of an equal first column side by side, then second.

    Rows are ordered by a 64-bit hash and compared in full, so rows of one hash are never mixed up; at
    worst some equal ones stay apart, which a later sum mends.
    """
    if not len(n):
        return columns, n
    if len(columns) == 1:
        key = columns[0].view(U64)
    else:
        share = 64 // len(columns) if len(columns) < 3 else 20
        key, left = np.zeros(len(n), U64), 64
        for i, c in enumerate(columns):
            width = left if i == len(columns) - 1 else min(left, 64 - share * (len(columns) - 1) if i == 0 else share)
            left -= width
            key |= (mix(c.view(U64)) >> U64(64 - width)) << U64(left)
    order = np.argsort(key)
    columns, n = [c[order] for c in columns], n[order]
    at = runs(columns)
    return [c[at] for c in columns], np.add.reduceat(n, at)


@dataclass
class Tally:
    """Counts of rows, merged when `most` have come in; `full` tells that the merged rows are many too."""

    most: int = 1 << 20
    parts: list = field(default_factory=list)
    size: int = 0
    full: bool = False

    def add(self, columns: list[np.ndarray], n: np.ndarray) -> None:
        self.parts.append((columns, n))
        self.size += len(n)
        if self.size > self.most:
            columns, n = self.take()
            self.parts, self.size = [(columns, n)], len(n)
            self.full = 2 * self.size > self.most

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All rows and their counts; the tally is empty then."""
        if not self.parts:
            return [], np.zeros(0, np.int64)
        columns = [np.concatenate(c) for c in zip(*(p[0] for p in self.parts), strict=True)]
        n = np.concatenate([p[1] for p in self.parts])
        self.parts, self.size, self.full = [], 0, False
        return summed(columns, n)
