"""Indicator arithmetic on aligned values, versions and warm-up flags.

A value is None where it is undefined; an undefined value in a window leaves the
result undefined. Ranges and slopes of series of different lengths go as far as the
shorter one; map_zip() wants equal lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Number = float | None


@dataclass(frozen=True)
class Aligned:
    values: list[Number]
    versions: list[int]
    warmup: list[bool]

    def __post_init__(self):
        if not len(self.values) == len(self.versions) == len(self.warmup):
            raise ValueError("values, versions and warmup differ in length")

    def map_zip(self, other: Aligned, f: Callable[[float, float], Number]) -> Aligned:
        if len(self.values) != len(other.values):
            raise ValueError("series differ in length")
        values = [None if a is None or b is None else f(a, b) for a, b in zip(self.values, other.values, strict=True)]
        known = [a is not None and b is not None for a, b in zip(self.values, other.values, strict=True)]
        return Aligned(
            values,
            [max(p) for p in zip(self.versions, other.versions, strict=True)],
            [k and a and b for k, a, b in zip(known, self.warmup, other.warmup, strict=True)],
        )

    def map_unary(self, f: Callable[[float], Number]) -> Aligned:
        return Aligned([None if v is None else f(v) for v in self.values], self.versions, self.warmup)


def bar_return(before: Number, now: Number) -> Number:
    """Relative change; none for missing or non-positive prices and beyond fivefold."""
    if before is None or now is None or before <= 0 or now <= 0:
        return None
    change = now / before - 1
    return None if abs(change) > 5 else change


def ret_series(x: Aligned) -> Aligned:
    out = [None, *(bar_return(a, b) for a, b in zip(x.values, x.values[1:], strict=False))][: len(x.values)]
    return Aligned(out, x.versions, [v is not None for v in out])


def true_range(high: float, low: float, before: float) -> float:
    return max(high - low, abs(high - before), abs(low - before))


def tr_series(high: list[Number], low: list[Number], close: Aligned) -> Aligned:
    out: list[Number] = []
    for i, (h, l, _) in enumerate(zip(high, low, close.values, strict=False)):
        known = i > 0 and None not in (h, l, close.values[i - 1])
        out.append(true_range(h, l, close.values[i - 1]) if known else None)
    return Aligned(out, close.versions[: len(out)], [v is not None for v in out])


def rolling_stat(x: Aligned, n: int, f: Callable[[list[float]], Number]) -> Aligned:
    """f over each full window; warm where f gives a value."""
    values, versions = [], []
    for i in range(len(x.values)):
        window = x.values[i + 1 - n : i + 1] if 0 < n <= i + 1 else [None]
        full = None not in window
        values.append(f(window) if full else None)
        versions.append(max(x.versions[i + 1 - n : i + 1]) if full else x.versions[i])
    return Aligned(values, versions, [v is not None for v in values])


def _mean(w: list[float]) -> float:
    return sum(w) / len(w)


def _variance(w: list[float]) -> float:
    return sum(v * v for v in w) / len(w) - _mean(w) ** 2


def rolling_avg(x: Aligned, n: int) -> Aligned:
    return rolling_stat(x, n, _mean)


def rolling_var(x: Aligned, n: int) -> Aligned:
    return rolling_stat(x, n, _variance)


def rolling_std(x: Aligned, n: int) -> Aligned:
    return rolling_stat(x, n, lambda w: math.sqrt(max(0.0, _variance(w))))


def rolling_count(x: Aligned, n: int) -> Aligned:
    return rolling_stat(x, n, lambda w: float(len(w)))


def ema_values(values: list[Number], n: int) -> list[Number]:
    """Seeded by the mean of the first n values without a gap; a later gap ends it."""
    out: list[Number] = [None] * len(values)
    if n < 1:
        return out
    run = 0
    for i, v in enumerate(values):
        run = run + 1 if v is not None else 0
        if run == n:
            break
    else:
        return out
    k, e = 2 / (n + 1), sum(values[i + 1 - n : i + 1]) / n
    out[i] = e
    for j in range(i + 1, len(values)):
        if values[j] is None:
            break
        e = values[j] * k + e * (1 - k)
        out[j] = e
    return out


def ema_series(x: Aligned, n: int) -> Aligned:
    out = ema_values(x.values, n)
    versions = list(x.versions)
    first = next((i for i, v in enumerate(out) if v is not None), None)
    if first is not None:
        versions[first] = max(x.versions[first + 1 - n : first + 1])
    return Aligned(out, versions, [v is not None for v in out])


def wilder_values(ranges: list[Number], n: int) -> list[Number]:
    """Wilder's average; ranges[0] is undefined, the seed is the mean of the next n."""
    out: list[Number] = [None] * len(ranges)
    if n < 1 or len(ranges) <= n or None in ranges[1 : n + 1]:
        return out
    a = sum(ranges[1 : n + 1]) / n
    out[n] = a
    for i in range(n + 1, len(ranges)):
        if ranges[i] is None:
            break
        a = (a * (n - 1) + ranges[i]) / n
        out[i] = a
    return out


def wilder_atr(high: list[Number], low: list[Number], close: Aligned, n: int) -> Aligned:
    out = wilder_values(tr_series(high, low, close).values, n)
    versions = list(close.versions[: len(out)])
    if len(out) > n and n > 0 and out[n] is not None:
        versions[n] = max(close.versions[: n + 1])
    return Aligned(out, versions, [v is not None for v in out])


def rsi_from_avgs(gain: float, loss: float) -> float:
    if loss == 0:
        return 100.0 if gain > 0 else 50.0
    return 100 - 100 / (1 + gain / loss)


def rsi_values(values: list[Number], n: int) -> list[Number]:
    out: list[Number] = [None] * len(values)
    if n < 1 or len(values) <= n or None in values:
        return out
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    gain = sum(max(s, 0.0) for s in steps[:n]) / n
    loss = sum(max(-s, 0.0) for s in steps[:n]) / n
    out[n] = rsi_from_avgs(gain, loss)
    for i in range(n, len(steps)):
        gain = (gain * (n - 1) + max(steps[i], 0.0)) / n
        loss = (loss * (n - 1) + max(-steps[i], 0.0)) / n
        out[i + 1] = rsi_from_avgs(gain, loss)
    return out


def wilder_rsi(x: Aligned, n: int) -> Aligned:
    out = rsi_values(x.values, n)
    return Aligned(out, x.versions, [v is not None for v in out])


def regr_slope(y: list[float], x: list[float]) -> Number:
    """Least-squares slope about the means; none if x does not vary."""
    my, mx = _mean(y), _mean(x)
    spread = sum((b - mx) ** 2 for b in x)
    return None if spread == 0 else sum((a - my) * (b - mx) for a, b in zip(y, x, strict=True)) / spread


def rolling_regr_slope(y: Aligned, x: Aligned, n: int) -> Aligned:
    """Slopes of full windows; warm where x varies in the window."""
    values, versions = [], []
    for i in range(min(len(y.values), len(x.values))):
        part = slice(i + 1 - n, i + 1)
        full = 2 <= n <= i + 1 and None not in y.values[part] and None not in x.values[part]
        values.append(regr_slope(y.values[part], x.values[part]) if full else None)
        versions.append(max(*y.versions[part], *x.versions[part]) if full else 0)
    return Aligned(values, versions, [v is not None for v in values])


def smoothed(x: np.ndarray, first: float, keep: float, block: int = 64) -> np.ndarray:
    """out[0] = first and out[i] = keep * out[i - 1] + (1 - keep) * x[i], in blocks of vector operations."""
    n = len(x) - 1
    out = np.empty(n + 1)
    out[0] = first
    if not n:
        return out
    steps = np.arange(block)
    weights = np.where(steps[:, None] >= steps, keep ** np.maximum(steps[:, None] - steps, 0), 0.0) * (1 - keep)
    rows = np.zeros((-(-n // block), block))
    rows.ravel()[:n] = x[1:]
    rows = rows @ weights.T  # each block as if it began at nothing
    fade, level = keep ** (steps + 1), first
    for i in range(len(rows)):
        rows[i] += fade * level
        level = rows[i, -1]
    out[1:] = rows.ravel()[:n]
    return out
