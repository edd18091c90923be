"""Executes indicator queries over a catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.folds import with_folds
from barloom.operators.lowering import Lowering, guarded_return
from barloom.plans.analysis import Analysis, analyze
from barloom.plans.domain import Absolute, emit_bounds
from barloom.plans.errors import QueryError
from barloom.plans.syntax import Index, Query, Series, parse
from barloom.sources.catalog import EMPTY_HASH, Catalog

LOWEST = -(1 << 63)
MOST_BROADCAST = 1_000_000  # timestamps of a page, or bars of a benchmark, of about 32 bytes each
MOST_RANKED = 1000  # timestamps of a page that are found by rank; more take a second pass
MOST_COINS = 10_000  # coins of a request whose assets are broadcast
SCHEMA = "coin string, indicator string, timestamp_start long, timestamp_end long, value {}, version long, warmup_complete boolean"


@dataclass(frozen=True)
class Request:
    """What to compute, for which assets, and which page of it.

    assets None takes all of the catalog. limit counts distinct timestamps; None returns all. object_types and scalar_types
    are added to the catalog's.
    """

    expr: str
    assets: list[str] | None
    params: dict = field(default_factory=dict)
    reporting_period: str | None = None
    after_ts: int = -1
    limit: int | None = 16
    publish_from: int | None = None
    object_types: frozenset[str] = frozenset()
    scalar_types: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Plan:
    request: Request
    query: Query
    analysis: Analysis
    path: str  # computed, object or raw


def plan(request: Request, catalog: Catalog | None = None, query: Query | None = None) -> Plan:
    """Parse, unless the query is given, check and route; raises QueryError."""
    query = parse(request.expr) if query is None else query

    def fail(message: str, pos: int | None = None):
        raise QueryError("compile_error", message, request.expr, pos)

    if request.assets is not None and not request.assets:
        fail("assets must be non-empty")
    if request.limit is not None and request.limit < 1:
        fail("limit must be >= 1")
    objects = set(request.object_types) | set(catalog.object_types if catalog else ())
    scalars = set(request.scalar_types) | set(catalog.scalar_types if catalog else ())
    a = analyze(query, request.expr, request.params, objects, scalars)
    if request.reporting_period is not None and request.reporting_period != a.period:
        fail(f"request reporting_period `{request.reporting_period}` conflicts with grammar bucket `{a.period}`")
    if both := a.objects & a.scalars:
        fail(f"series [{min(both)}] is stored as both object and scalar")
    if a.objects and (a.scalars or a.computed):
        fail("cannot mix object and scalar series in one query")
    if a.scalars and a.computed:
        fail("cannot mix raw stored series and computed series in one query")
    path = "object" if a.objects else "raw" if a.scalars else "computed"
    for member in query.members.values():
        _check_items(member, path, fail)
    if path != "computed":
        for member in query.members.values():
            if not isinstance(member, Series):
                fail(f"{'object' if path == 'object' else 'raw stored-scalar'} series cannot be wrapped in an operator")
        if len(a.objects | a.scalars) > 1:
            fail("all series of the query must share the same stem")
    return Plan(request, query, a, path)


def _check_items(node, path: str, fail) -> None:
    if isinstance(node, Series):
        if node.item is not None and path != "object":
            fail("field accessor requires an object series", node.pos)
        return
    children = [node.inner] if isinstance(node, Index) else [*getattr(node, "args", ()), *(getattr(node, s) for s in ("left", "right") if hasattr(node, s))]
    for child in children:
        _check_items(child, path, fail)


def execute(catalog: Catalog, request: Request, strict: bool = True) -> DataFrame:
    """Rows of SCHEMA, ordered by timestamp_start, coin and indicator.

    value is a double for computed series and a string for stored ones. Unless the
    emit range is absolute, its bounds are read first with one aggregation.
    """
    p = plan(request, catalog)
    rows = _computed(catalog, p, strict) if p.path == "computed" else _fetched(catalog, p)
    if rows is None:
        return catalog.data.sparkSession.createDataFrame([], SCHEMA.format("double" if p.path == "computed" else "string"))
    return page(rows, request).orderBy("timestamp_start", "coin", "indicator")


def page(rows: DataFrame, request: Request) -> DataFrame:
    """Rows of the first limit timestamps after the cursor."""
    start = LOWEST if request.publish_from is None else request.publish_from
    rows = rows.filter((F.col("value").isNotNull()) & (F.col("timestamp_start") >= start) & (F.col("timestamp_start") > request.after_ts))
    if request.limit is None:
        return rows
    if request.limit <= MOST_RANKED:  # each task keeps its first timestamps, before one sorts them
        place = F.dense_rank().over(Window.orderBy("timestamp_start"))
        return rows.withColumn("place", place).filter(F.col("place") <= request.limit).drop("place")
    first = rows.select("timestamp_start").distinct().orderBy("timestamp_start").limit(request.limit)
    return rows.join(F.broadcast(first) if request.limit <= MOST_BROADCAST else first, "timestamp_start", "left_semi").select(rows.columns)


def _named(catalog: Catalog, coins: list[str] | None) -> DataFrame:
    """asset and coin of the coins asked for, broadcast where they are few."""
    named = catalog.assets if coins is None else catalog.assets.filter(F.col("canonical_ticker").isin(coins))
    named = named.select(F.col("id").alias("asset"), F.col("canonical_ticker").alias("coin"))
    return F.broadcast(named) if coins is not None and len(coins) <= MOST_COINS else named


def _facts(facts: DataFrame, catalog: Catalog, a: Analysis, coins: list[str] | None, data_type: str) -> DataFrame:
    """Rows of one series with their coin; the coins asked for bound the broadcast."""
    rows = facts.filter((F.col("data_type") == data_type) & (F.col("reporting_period") == a.period) & (F.col("params_hash") == a.params_hash))
    return rows.join(_named(catalog, coins), "asset")


def _bounds(rows: DataFrame, a: Analysis, padding: int) -> tuple[int, int] | None:
    if isinstance(a.domain, Absolute):
        return a.domain.start, a.domain.end
    found = rows.agg(F.min("timestamp_start"), F.max("timestamp_start")).first()
    return None if found[0] is None else emit_bounds(a.domain, found[0], found[1], a.interval, padding)


def _computed(catalog: Catalog, p: Plan, strict: bool) -> DataFrame | None:
    a, step = p.analysis, p.analysis.interval
    closes = _facts(catalog.data, catalog, a, p.request.assets, "close")
    bounds = _bounds(closes, a, a.lookback)
    if bounds is None:
        return None
    low, high = bounds
    scanned = F.col("timestamp_start").between(max(LOWEST, low - a.lookback * step), high)
    rows = closes.filter(scanned).select("asset", "coin", "timestamp_start", F.col("value").alias("close"), "version")
    nth = F.row_number().over(Window.partitionBy("coin").orderBy("timestamp_start")).cast("long")
    rows = rows.withColumn("seg_key", F.col("timestamp_start") - (nth - 1) * step)
    if a.needs_ohlc:
        if catalog.candles is None:
            raise QueryError("compile_error", "the catalog has no candles", p.request.expr)
        # candles are stored without source or other identity
        candles = catalog.candles.filter((F.col("reporting_period") == a.period) & (F.col("params_hash") == EMPTY_HASH) & scanned)
        if p.request.assets is not None:
            candles = candles.join(_named(catalog, p.request.assets).select("asset"), "asset", "left_semi")
        rows = rows.join(candles.select("asset", "timestamp_start", "open", "high", "low"), ["asset", "timestamp_start"], "left")
    for i, ticker in enumerate(a.tickers):
        own = Window.partitionBy("asset").orderBy("timestamp_start")
        bench = _facts(catalog.data, catalog, a, [ticker], "close").filter(scanned)
        change = guarded_return(F.col("value"), F.lag("value").over(own), None)
        bench = bench.select("timestamp_start", F.col("value").alias(f"bench_close_{i}"), change.alias(f"bench_ret_{i}")).filter(F.col(f"bench_ret_{i}").isNotNull())
        # a coin has one bar at each step of the range
        small = high - max(LOWEST, low - a.lookback * step) < MOST_BROADCAST * step
        rows = rows.join(F.broadcast(bench) if small else bench, "timestamp_start", "left")
    lowering = Lowering(a, p.request.params, p.request.expr, strict)
    members = {name: lowering.lower(member) for name, member in p.query.members.items()}
    for level in lowering.folds:
        rows = with_folds(rows, level)
    # one projection over shared windows, then one row for each member
    each = [
        F.struct(
            F.lit(name).alias("indicator"),
            m.value.cast("double").alias("value"),
            (m.version if m.version is not None else F.lit(None)).cast("long").alias("version"),
            m.warmup.alias("warmup_complete"),
        )
        for name, m in members.items()
    ]
    wide = rows.select("coin", "timestamp_start", *(s.alias(f"m_{i}") for i, s in enumerate(each)))
    long = wide.select("coin", "timestamp_start", F.explode(F.array(*(F.col(f"m_{i}") for i in range(len(each))))).alias("m"))
    out = long.filter(F.col("timestamp_start").between(low, high))
    return out.select("coin", "m.indicator", "timestamp_start", (F.col("timestamp_start") + step).alias("timestamp_end"), "m.value", "m.version", "m.warmup_complete")


def _fetched(catalog: Catalog, p: Plan) -> DataFrame | None:
    a = p.analysis
    stem = min(a.objects | a.scalars)
    facts = catalog.objects if p.path == "object" else catalog.data
    if facts is None:
        raise QueryError("compile_error", "the catalog has no objects", p.request.expr)
    rows = _facts(facts, catalog, a, p.request.assets, stem)
    bounds = _bounds(rows, a, 1)
    if bounds is None:
        return None
    each = []
    for name, member in p.query.members.items():
        value = F.get_json_object("value", f"$['{member.item}']") if member.item else F.col("value").cast("string")
        each.append(F.struct(F.lit(name).alias("indicator"), value.alias("value")))
    long = rows.filter(F.col("timestamp_start").between(*bounds)).select("coin", "timestamp_start", "version", F.explode(F.array(*each)).alias("m"))
    return long.select("coin", "m.indicator", "timestamp_start", (F.col("timestamp_start") + a.interval).alias("timestamp_end"), "m.value", "version", F.lit(True).alias("warmup_complete"))
