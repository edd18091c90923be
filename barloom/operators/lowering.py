"""From checked expressions to columns and windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.plans.analysis import Analysis, window_length
from barloom.plans.errors import QueryError
from barloom.plans.syntax import Binary, Call, Index, Literal, Param, Series


def segment():
    return Window.partitionBy("coin", "seg_key").orderBy("timestamp_start")


#: Where PostgreSQL raises an error and Spark gives NaN or infinity.
_OUTSIDE = {
    "SQRT": lambda x: x < 0,
    "ASIN": lambda x: F.abs(x) > 1,
    "ACOS": lambda x: F.abs(x) > 1,
    "ACOSH": lambda x: x < 1,
    "ATANH": lambda x: F.abs(x) >= 1,
}


@dataclass(frozen=True)
class Lowered:
    value: Column
    version: Column | None
    warmup: Column
    whole: bool = False  # an integer, so that division truncates


@dataclass(frozen=True)
class Fold:
    """A path-dependent column: what it computes, over which column, and its name."""

    op: str
    length: int
    argument: Column
    own_close: bool
    name: str


def frame(n: int):
    return segment().rowsBetween(-(n - 1), 0)


def guarded_return(now: Column, before: Column, most: float | None = 5.0) -> Column:
    change = now / before - 1
    good = (before > 0) & (now > 0)
    if most is not None:
        good = good & (F.abs(F.when(good, change)) <= most)
    return F.when(good, change)


@dataclass
class Lowering:
    """Lowers members one by one; folds collects what needs an ordered pass first.

    The engine materialises the folds of a level as columns before the expressions
    that use them; `level` tells how deep folds stand in each other.
    """

    analysis: Analysis
    params: dict
    expr: str
    strict: bool = True
    folds: list[list[Fold]] = field(default_factory=list)

    def lower(self, node) -> Lowered:
        match node:
            case Literal(value=v):
                return self.constant(v)
            case Param(name=name):
                return self.constant(self.params[name])
            case Index(inner=inner):
                return self.lower(inner)
            case Series():
                return self.series(node)
            case Binary():
                return self.binary(node)
            case Call():
                return self.call(node)
        raise AssertionError(node)

    def constant(self, v: int | float) -> Lowered:
        whole = float(v).is_integer() and abs(v) < 1 << 63
        return Lowered(F.lit(int(v)).cast("long") if whole else F.lit(float(v)), None, F.lit(True), whole)

    def bench(self, s: Series) -> int:
        ticker = self.params[s.asset.name] if isinstance(s.asset, Param) else s.asset
        return self.analysis.tickers.index(ticker)

    def series(self, s: Series) -> Lowered:
        if s.asset is not None:
            if s.name != "close":
                raise QueryError("compile_error", "an `@ticker` series currently only supports [close]", self.expr, s.pos)
            value = F.col(f"bench_close_{self.bench(s)}")
        else:
            value = F.col(s.name)
        return Lowered(value, F.col("version"), F.lit(True))

    @staticmethod
    def joined(parts: list[Lowered]) -> tuple[Column | None, Column]:
        versions = [p.version for p in parts if p.version is not None]
        version = None if not versions else versions[0] if len(versions) == 1 else F.greatest(*versions)
        warm = parts[0].warmup
        for p in parts[1:]:
            warm = warm & p.warmup
        return version, warm

    def binary(self, node: Binary) -> Lowered:
        a, b = self.lower(node.left), self.lower(node.right)
        version, warm = self.joined([a, b])
        whole = a.whole and b.whole
        if node.op == "/":
            value = F.call_function("div", a.value, b.value) if whole else a.value.cast("double") / b.value.cast("double")
        else:
            value = {"+": a.value.__add__, "-": a.value.__sub__, "*": a.value.__mul__}[node.op](b.value)
        return Lowered(value, version, warm, whole)

    def level(self, node) -> int:
        """How many folds stand inside each other below and at node."""
        match node:
            case Call(op=op, args=args):
                return max((self.level(a) for a in args), default=0) + (op in ("EMA", "RMA", "RSI"))
            case Binary(left=a, right=b):
                return max(self.level(a), self.level(b))
            case Index(inner=inner):
                return self.level(inner)
        return 0

    def call(self, c: Call) -> Lowered:
        op = c.op
        if op == "RET":
            inner = c.args[0]
            if isinstance(inner, Series) and inner.asset is not None and inner.name == "close":
                return Lowered(F.col(f"bench_ret_{self.bench(inner)}"), F.col("version"), F.lit(True))
            x = self.lower(inner)
            now = x.value.cast("double")
            return Lowered(guarded_return(now, F.lag(now).over(segment())), x.version, F.lit(True))
        if op == "TR":
            before = F.lag("close").over(segment())
            high, low = F.col("high"), F.col("low")
            return Lowered(F.greatest(high - low, F.abs(high - before), F.abs(low - before)), F.col("version"), before.isNotNull())
        if c.window is not None:
            return self.windowed(c)
        parts = [self.lower(a) for a in c.args]
        version, warm = self.joined(parts)
        values = [p.value.cast("double") for p in parts]
        if op == "POWER":
            bad = (values[0] == 0) & (values[1] < 0) | (values[0] < 0) & (F.floor(values[1]) != values[1])
            return Lowered(self.checked(F.pow(*values), bad, op), version, warm)
        if op == "GREATEST":
            whole = all(p.whole for p in parts)
            return Lowered(F.greatest(*(p.value if whole else v for p, v in zip(parts, values, strict=True))), version, warm, whole)
        if op == "ABS" and parts[0].whole:
            return Lowered(F.abs(parts[0].value), version, warm, True)
        value = getattr(F, op.lower())(values[0])
        return Lowered(self.checked(value, _OUTSIDE[op](values[0]), op) if op in _OUTSIDE else value, version, warm)

    def checked(self, value: Column, outside: Column, op: str) -> Column:
        if not self.strict:
            return value
        return F.when(outside, F.raise_error(F.lit(f"{op}: argument outside its domain")).cast("double")).otherwise(value)

    def windowed(self, c: Call) -> Lowered:
        n = window_length(c, self.params, self.expr)
        if isinstance(c.window, tuple) and c.window[0].origin:
            n = self.analysis.lookback  # as wide as the query's longest lookback
        parts = [self.lower(a) for a in c.args]
        version = F.max("version").over(frame(n))
        x = parts[0].value.cast("double")
        if c.op in ("EMA", "RMA", "RSI"):
            return self.folded(c, n, x, version)
        warm = F.count(F.lit(1)).over(frame(n)) >= n
        if c.op == "COUNT":
            return Lowered(F.count(F.lit(1)).over(frame(n)), version, warm, True)
        if c.op == "REGR":
            return Lowered(F.regr_slope(x, parts[1].value.cast("double")).over(frame(n)), version, warm)
        mean = F.avg(x).over(frame(n))
        if c.op == "AVG":
            return Lowered(mean, version, warm)
        variance = F.avg(x * x).over(frame(n)) - mean * mean
        return Lowered(variance if c.op == "VAR" else F.sqrt(F.greatest(F.lit(0.0), variance)), version, warm)

    def folded(self, c: Call, n: int, x: Column, version: Column) -> Lowered:
        inner = c.args[0]
        depth = self.level(c) - 1
        while len(self.folds) <= depth:
            self.folds.append([])
        own_close = isinstance(inner, Series) and inner.name == "close" and inner.asset is None
        name = f"fold_{depth}_{len(self.folds[depth])}"
        self.folds[depth].append(Fold(c.op, n, x, own_close, name))
        need = n + (c.op != "EMA")
        bars_so_far = (F.col("timestamp_start") - F.col("seg_key")) / self.analysis.interval + 1
        return Lowered(F.col(name), version, bars_so_far >= need)
