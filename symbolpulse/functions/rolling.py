"""Values and aggregates of the rows before, for batches of whole tickers inside a task.

A batch holds its rows by ticker and date.  An aggregate of ``n`` rows takes ``n`` steps over whole columns, from the
oldest row to the newest, in the order in which a window would add them; the cost of a row does not hang on how many
aggregates share a frame.  A column is a pair of values and of what is known of them, so that NULL and NaN stay apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd

Known = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Rolling:
    """``kind`` of aggregate of ``columns`` over the ``n`` rows before, if ``least`` of them have a value.

    Kinds are the methods of :class:`Batch`, and the lines of its ``macd``, which look at all rows before.
    """

    kind: str
    columns: tuple[str, ...]
    n: int
    least: int


class Batch:
    """Rows of whole tickers; ``read`` gives a column, ``place`` counts the rows of a ticker from 0."""

    def __init__(self, place: np.ndarray, read: Callable[[str], Known]):
        self.place, self.read = place, cache(read)
        self.start = np.arange(len(place)) - place
        self.moments = cache(self._moments)
        self.macd = cache(self._macd)

    def back(self, column: Known, k: int) -> Known:
        """The column ``k`` rows before."""
        value, known = np.zeros_like(column[0]), np.zeros_like(column[1])
        value[k:], known[k:] = column[0][:-k], column[1][:-k]
        return value, known & (self.place >= k)

    def _moments(self, name: str, n: int, also: str = "") -> tuple[np.ndarray, ...]:
        """Count, sum, and sum of squared distances from the mean; with ``also``, of rows in which that column is known."""
        column, size = self.read(name), len(self.place)
        if also:
            column = column[0], column[1] & self.read(also)[1]
        count, total, mean, square = (np.zeros(size) for _ in range(4))
        for k in range(n, 0, -1):
            x, known = self.back(column, k)
            count += known
            total += np.where(known, x, 0.0)
            delta = np.where(known, x - mean, 0.0)
            step = delta / np.maximum(count, 1.0)
            mean += step
            square += delta * (delta - step)
        return count, total, square

    def _joint(self, x: str, y: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of products of distances from both means, and whether both columns vary."""
        a, b = self.read(x), self.read(y)
        size, both = len(self.place), a[1] & b[1]
        count, mean_a, mean_b, product = (np.zeros(size) for _ in range(4))
        # Column x counts where it is known, y where both are.  NaN lies above all numbers.
        high, low = np.full((2, size), -np.inf), np.full((2, size), np.nan)
        for k in range(n, 0, -1):
            (p, known), (q, paired) = self.back(a, k), self.back((b[0], both), k)
            count += paired
            delta = np.where(paired, p - mean_a, 0.0)
            mean_a += delta / np.maximum(count, 1.0)
            mean_b += np.where(paired, q - mean_b, 0.0) / np.maximum(count, 1.0)
            product += np.where(paired, delta * (q - mean_b), 0.0)
            for i, (value, seen) in enumerate(((p, known), (q, paired))):
                high[i] = np.where(seen, np.maximum(high[i], value), high[i])
                low[i] = np.where(seen, np.fmin(low[i], value), low[i])
        varies = (high > low) | (np.isnan(high) & ~np.isnan(low))
        return product / np.maximum(count, 1.0), varies[0] & varies[1]

    def before(self, name: str, n: int, least: int) -> Known:
        return self.back(self.read(name), n)

    def growth(self, name: str, n: int, least: int) -> Known:
        """From ``n`` rows before the row before to that row."""
        ratio, known = _ratio(self.back(self.read(name), 1), self.back(self.read(name), n + 1))
        return ratio - 1, known

    def mean(self, name: str, n: int, least: int) -> Known:
        count, total, _ = self.moments(name, n)
        return total / np.maximum(count, 1.0), count >= least

    def sum(self, name: str, n: int, least: int) -> Known:
        count, total, _ = self.moments(name, n)
        return total, count >= least

    def std(self, name: str, n: int, least: int) -> Known:
        count, _, square = self.moments(name, n)
        return np.sqrt(square / np.maximum(count - 1.0, 1.0)), count >= max(least, 2)

    def corr(self, x: str, y: str, n: int, least: int) -> Known:
        (count, _, square), (paired, _, other) = self.moments(x, n), self.moments(y, n, x)
        joint, varies = self._joint(x, y, n)
        spread = np.sqrt(square / np.maximum(count, 1.0)) * np.sqrt(other / np.maximum(paired, 1.0))
        return _ratio((joint, (count >= least) & varies), (spread, varies))

    def rsi(self, gain: str, loss: str, n: int, least: int) -> Known:
        ratio, known = _ratio(self.mean(gain, n, least), self.mean(loss, n, least))
        inverse, known = _ratio((np.full(len(ratio), 100.0), known), (1 + ratio, known))
        return 100 - inverse, known

    def upper(self, name: str, n: int, least: int) -> Known:
        (middle, known), (width, wide) = self.mean(name, n, least), self.std(name, n, least)
        return middle + 2 * width, known & wide

    def lower(self, name: str, n: int, least: int) -> Known:
        (middle, known), (width, wide) = self.mean(name, n, least), self.std(name, n, least)
        return middle - 2 * width, known & wide

    def recursive_mean(self, column: Known, span: int) -> Known:
        """Recursive mean from the first value of a ticker on; rows without a value keep the mean before."""
        value, known = column
        series = pd.Series(np.where(known, value, np.nan)).groupby(self.start, sort=False)
        mean = series.ewm(span=span, adjust=False).mean().to_numpy()
        # What is no number stays in the mean.
        broken = self._seen(known & np.isnan(value))
        return np.where(broken, np.nan, mean), self._seen(known)

    def _seen(self, flag: np.ndarray) -> np.ndarray:
        """Is ``flag`` set in this row or one before it?"""
        return self._last(flag) >= self.start

    def _last(self, flag: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))

    def _macd(self, name: str) -> dict[str, Known]:
        close = self.read(name)
        (fast, known), (slow, _) = self.recursive_mean(close, 12), self.recursive_mean(close, 26)
        macd = fast - slow, known
        signal = self.recursive_mean(macd, 9)
        lines = {"macd": macd, "signal": signal, "hist": (macd[0] - signal[0], known & signal[1])}
        return {line: self.back(column, 1) for line, column in lines.items()}

    def filled(self, column: Known) -> Known:
        """Last known value, 0 before the first."""
        last = self._last(column[1])
        return np.where(last >= self.start, column[0][last], 0.0), np.ones(len(last), dtype=bool)

    def feature(self, spec: Rolling) -> Known:
        if spec.kind in ("macd", "signal", "hist"):
            return self.macd(*spec.columns)[spec.kind]
        return getattr(self, spec.kind)(*spec.columns, spec.n, spec.least)


def _ratio(over: Known, under: Known) -> Known:
    """``over / under``, NULL where that is zero."""
    zero = under[0] == 0
    return over[0] / np.where(zero, 1.0, under[0]), over[1] & under[1] & ~zero
