"""The kernels over columns of a DataFrame.

Rows of one series share the columns `by` and are in the order of the column `order`;
a series is taken as it stands, without regard to gaps. Every kernel gives a struct of
value, version and warmup, null values where it is undefined, with the rules of
kernels.py. Windowed kernels are columns; those that depend on the whole path add a
column in one ordered pass over each series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.folds import ema, rsi, wilder


def _kernel(value: Column, version: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), version.cast("long").alias("version"), value.isNotNull().alias("warmup"))


@dataclass(frozen=True)
class Rolling:
    """Windowed kernels of series given by the columns by, order and version."""

    by: tuple[str, ...]
    order: str
    version: str = "version"

    def _series(self):
        return Window.partitionBy(*self.by).orderBy(self.order)

    def _stat(self, x: Column, n: int, value) -> Column:
        """value(window) where all n values of a window are defined; versions are then the largest."""
        own = F.col(self.version)
        if n < 1:
            return _kernel(F.lit(None).cast("double"), own)
        w = self._series().rowsBetween(1 - n, 0)
        full = F.count(x).over(w) == n
        return _kernel(F.when(full, value(w)), F.when(full, F.max(own).over(w)).otherwise(own))

    def avg(self, x: Column, n: int) -> Column:
        return self._stat(x, n, lambda w: F.avg(x).over(w))

    def var(self, x: Column, n: int) -> Column:
        return self._stat(x, n, lambda w: F.avg(x * x).over(w) - F.avg(x).over(w) * F.avg(x).over(w))

    def std(self, x: Column, n: int) -> Column:
        return self._stat(x, n, lambda w: F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x).over(w) - F.avg(x).over(w) * F.avg(x).over(w))))

    def count(self, x: Column, n: int) -> Column:
        return self._stat(x, n, lambda w: F.lit(float(n)))

    def regr_slope(self, y: Column, x: Column, n: int) -> Column:
        """Version 0 where the window is not full; null where x does not vary in it."""
        if n < 2:
            return _kernel(F.lit(None).cast("double"), F.lit(0))
        w = self._series().rowsBetween(1 - n, 0)
        full = F.count(F.when(x.isNotNull(), y)).over(w) == n
        varies = F.max(x).over(w) > F.min(x).over(w)
        return _kernel(F.when(full & varies, F.regr_slope(y, x).over(w)), F.when(full, F.max(self.version).over(w)).otherwise(0))

    def ret(self, x: Column) -> Column:
        """Relative change; null for missing or non-positive values and beyond fivefold."""
        before = F.lag(x).over(self._series())
        good = (before > 0) & (x > 0)
        change = F.when(good, x / before - 1)
        return _kernel(F.when(F.abs(change) <= 5, change), F.col(self.version))

    def tr(self, high: Column, low: Column, close: Column) -> Column:
        before = F.lag(close).over(self._series())
        known = high.isNotNull() & low.isNotNull() & before.isNotNull()
        return _kernel(F.when(known, F.greatest(high - low, F.abs(high - before), F.abs(low - before))), F.col(self.version))

    def _path(self, df: DataFrame, name: str, x: Column, n: int, kind: str) -> DataFrame:
        """df with a column name of the kernel kind over x."""
        if n < 1:
            return df.withColumn(name, _kernel(F.lit(None).cast("double"), F.col(self.version)))
        argued = df.withColumns({"__x": x.cast("double"), "__out": F.lit(None).cast("double")})
        schema = T.StructType([f for f in argued.schema.fields if f.name != "__x"])
        order, many = self.order, {"ema": n, "atr": n + 1}.get(kind, 1)

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(order)
            x = group["__x"].to_numpy(dtype=np.float64, na_value=np.nan)
            group["__out"] = ema(x, n, False) if kind == "ema" else rsi(x, n, False) if kind == "rsi" else wilder(x, n)
            return group[schema.names]

        out = argued.groupBy(*self.by).applyInPandas(run, schema).withColumn("__out", F.nanvl("__out", F.lit(None).cast("double")))
        first = F.col("__out").isNotNull() & F.lag("__out").over(self._series()).isNull()
        seeded = F.max(self.version).over(self._series().rowsBetween(1 - many, 0))
        return out.withColumn(name, _kernel(F.col("__out"), F.when(first, seeded).otherwise(F.col(self.version)))).drop("__out")

    def with_ema(self, df: DataFrame, name: str, x: Column, n: int) -> DataFrame:
        """Seeded by the mean of the first n defined values in a row; a later gap ends it."""
        return self._path(df, name, x, n, "ema")

    def with_rsi(self, df: DataFrame, name: str, x: Column, n: int) -> DataFrame:
        """Wilder's strength index; a series with an undefined value has none."""
        return self._path(df, name, x, n, "rsi")

    def with_atr(self, df: DataFrame, name: str, high: Column, low: Column, close: Column, n: int) -> DataFrame:
        """Wilder's average of the true ranges, the seed is the mean of the second to the n + 1st."""
        ranged = df.withColumn("__range", self.tr(high, low, close)["value"])
        return self._path(ranged, name, F.col("__range"), n, "atr").drop("__range")
