"""Medians and moments of growing training sets, merged month by month.

State of a feature: its known values in order, their mean and squared deviations, and how many values
were missing. States merge, so each fold adds one month to the state before it and nothing is read twice.
"""

from __future__ import annotations

import numpy as np


class Expanding:
    """Mergeable state of one feature's values."""

    def __init__(self, values: np.ndarray | None = None) -> None:
        values = np.zeros(0) if values is None else np.asarray(values, dtype=float)
        self.known = np.sort(values[~np.isnan(values)])
        self.missing = len(values) - len(self.known)
        self.mean = float(self.known.mean()) if len(self.known) else 0.0
        self.squares = float(np.square(self.known - self.mean).sum())

    def merge(self, other: "Expanding") -> "Expanding":
        """This state with ``other``'s values added; ``other`` may be the smaller one."""
        n, m = len(self.known), len(other.known)
        if m:
            self.known = np.insert(self.known, np.searchsorted(self.known, other.known), other.known)
            apart = other.mean - self.mean
            self.squares += other.squares + apart * apart * n * m / (n + m)
            self.mean += apart * m / (n + m)
        self.missing += other.missing
        return self

    def fill(self) -> float:
        """The median of the known values; without any it is 0."""
        n = len(self.known)
        return float((self.known[(n - 1) // 2] + self.known[n // 2]) / 2) if n else 0.0

    def moments(self) -> tuple[float, float]:
        """Mean and population deviation once missing values are filled."""
        n, total = len(self.known), len(self.known) + self.missing
        if not total:
            return 0.0, 0.0
        apart = self.fill() - self.mean if n else 0.0
        base = self.mean if n else self.fill()
        squares = self.squares + apart * apart * n * self.missing / total
        return base + apart * self.missing / total, float(np.sqrt(max(0.0, squares / total)))
