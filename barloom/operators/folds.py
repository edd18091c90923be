"""Path-dependent indicators: one ordered pass over each gap-free segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.kernels import smoothed
from barloom.operators.lowering import Fold


def _chain(x: np.ndarray, at: int, seed: float, keep: float) -> np.ndarray:
    """The recurrence from the seed at a place up to the next undefined value."""
    out = np.full(len(x), np.nan)
    gaps = np.flatnonzero(np.isnan(x[at + 1 :]))
    end = at + 1 + (int(gaps[0]) if len(gaps) else len(x) - at - 1)
    out[at:end] = smoothed(x[at:end], seed, keep)
    return out


def ema(x: np.ndarray, n: int, own: bool) -> np.ndarray:
    """Seeded by the mean of n values: for row closes the first n, without the undefined
    ones; else the first n in a row that are defined. A later undefined value ends it."""
    known = ~np.isnan(x)
    if own:
        at = n - 1 if len(x) >= n and known[:n].any() else -1
    else:
        sums = np.concatenate([[0], np.cumsum(known)])
        whole = np.flatnonzero(sums[n:] - sums[:-n] == n) if len(x) >= n else []
        at = int(whole[0]) + n - 1 if len(whole) else -1
    if at < 0:
        return np.full(len(x), np.nan)
    return _chain(x, at, float(np.nanmean(x[at + 1 - n : at + 1])), 1 - 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """The first range is undefined; the seed is the mean of the next n."""
    if len(x) <= n or np.isnan(x[1 : n + 1]).any():
        return np.full(len(x), np.nan)
    return _chain(x, n, float(x[1 : n + 1].mean()), (n - 1) / n)


def rsi(x: np.ndarray, n: int, own: bool) -> np.ndarray:
    """For row closes a step from or to an undefined value is neither gain nor loss; else it leaves all undefined."""
    out = np.full(len(x), np.nan)
    if len(x) <= n or not own and np.isnan(x).any():
        return out
    steps = np.nan_to_num(np.diff(x), nan=0.0)
    up, down = np.maximum(steps, 0), np.maximum(-steps, 0)
    keep = (n - 1) / n
    gain, loss = (smoothed(s[n - 1 :], float(s[:n].mean()), keep) for s in (up, down))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[n:] = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss))
    return out


def with_folds(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """Add a column for each fold; a segment is bounded by the padded emit range."""
    argued = df.withColumns({f"{f.name}_of": f.argument for f in folds})
    plan = [(f.op, f.length, f.own_close, f.name) for f in folds]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f.name, T.DoubleType()) for f in folds)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("timestamp_start")
        for op, n, own, name in plan:
            x = group[f"{name}_of"].to_numpy(dtype=np.float64, na_value=np.nan)
            group[name] = ema(x, n, own) if op == "EMA" else rsi(x, n, own) if op == "RSI" else wilder(x, n)
        return group[schema.names]

    return argued.groupBy("coin", "seg_key").applyInPandas(run, schema)
