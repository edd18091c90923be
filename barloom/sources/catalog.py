"""The tables that queries read, and bars made from raw events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.intervals import interval_ms, params_hash

EMPTY_HASH = params_hash({})


@dataclass(frozen=True)
class Catalog:
    """Facts keyed by asset, data_type, reporting_period, params_hash, timestamp_start.

    data has double values; candles have open, high, low, close and volume and no
    data_type; objects have JSON text. assets maps id to canonical_ticker. Keys must be
    unique: latest_versions() makes them so. object_types and scalar_types name the
    stored series that may be fetched as they are.
    """

    data: DataFrame
    assets: DataFrame
    candles: DataFrame | None = None
    objects: DataFrame | None = None
    object_types: frozenset[str] = field(default_factory=frozenset)
    scalar_types: frozenset[str] = field(default_factory=frozenset)


def latest_versions(facts: DataFrame) -> DataFrame:
    """One row a key, that of the largest version."""
    keys = [c for c in ("asset", "data_type", "reporting_period", "params_hash", "timestamp_start") if c in facts.columns]
    rest = [c for c in facts.columns if c not in (*keys, "version")]
    best = F.max(F.struct("version", *rest)).alias("best")
    return facts.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in facts.columns))


def utc_micros(time: Column, without_zone: bool) -> Column:
    """Epoch microseconds; a time without zone counts as UTC, whatever the session's zone is."""
    if not without_zone:
        return F.unix_micros(time)
    seconds = F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def bars(ticks: DataFrame, period: str, coin: str, micros: Column, value: str, order: str) -> DataFrame:
    """coin, timestamp_start, open, high, low, close, volume, version of each bar.

    micros is a column of epoch microseconds, of which the nearest millisecond decides the
    bar; order breaks ties of time and gives the version. Ticks without a value give no price, but count as volume; ticks of a null
    coin make bars of a null coin. The aggregation combines before its only shuffle; time
    and order, which must be whole numbers, are one decimal, so that it hashes and never
    sorts the ticks.
    """
    step = interval_ms(period)
    whole = lambda n: F.expr(f"cast({n} as decimal(20, 0))")
    after = F.coalesce(F.col(order).cast("decimal(20, 0)") + whole(1 << 63), whole(1 << 64))  # null last
    moment = F.when(F.col(value).isNotNull(), micros.cast("decimal(18, 0)") * whole(1 << 65) + after)
    millis = F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))
    return ticks.groupBy(F.col(coin).alias("coin"), (F.floor(millis / step).cast("long") * step).alias("timestamp_start")).agg(
        F.min_by(value, moment).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, moment).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.max(order).cast("long").alias("version"),
    )


def catalog_of_bars(source: DataFrame, period: str, **more) -> Catalog:
    """A catalog whose close and candle series are bars."""
    known = source.withColumn("asset", F.xxhash64("coin"))
    keys = [F.col("asset"), F.lit(period).alias("reporting_period"), F.lit(EMPTY_HASH).alias("params_hash"), F.col("timestamp_start")]
    data = known.select(*keys, F.lit("close").alias("data_type"), F.col("close").cast("double").alias("value"), "version")
    candles = known.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), "version")
    assets = known.select(F.col("asset").alias("id"), F.col("coin").alias("canonical_ticker")).distinct()
    return Catalog(data, assets, candles, **more)


def candles_from_json(rows: DataFrame) -> DataFrame:
    """Candle facts from JSON text, flat or as the first of a list named candles."""
    parts = [F.coalesce(F.get_json_object("value", f"$.{c}"), F.get_json_object("value", f"$.candles[0].{c}")).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select("asset", "reporting_period", "params_hash", "timestamp_start", *parts, "version")
