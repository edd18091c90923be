"""Queries over bars of the events table, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import Rolling
from barloom.functions.intervals import INTERVALS, params_hash, params_hash_for_source
from barloom.operators.engine import Request, execute
from barloom.sources.catalog import Catalog, bars, catalog_of_bars, utc_micros

HOUR = 3_600_000
START = 1_704_067_200_000  # 2024-01-01
PARAMS = {"from": START + 100 * HOUR, "to": START + 400 * HOUR, "end": START + 500 * HOUR, "period": 14, "n": 24, "bench": "view", "bars_per_year": 8760.0, "scale": 1000.5}


def event_bars(spark: SparkSession, sf_dir: str, period: str = "1h") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value")
    without_zone = dict(events.dtypes)["ts"] == "timestamp_ntz"
    return bars(events, period, "event_type", utc_micros(F.col("ts"), without_zone), "value", "event_id")


def event_catalog(spark: SparkSession, sf_dir: str, period: str = "1h") -> Catalog:
    """Close and candle bars, JSON objects of the same, and a stored average."""
    source = event_bars(spark, sf_dir, period)
    base = catalog_of_bars(source, period, object_types=frozenset({"ohlc"}), scalar_types=frozenset({"sma"}))
    objects = base.candles.select("asset", F.lit("ohlc").alias("data_type"), "reporting_period", "params_hash", "timestamp_start", F.to_json(F.struct("open", "high", "low", "close")).alias("value"), "version")
    stored = base.data.select("asset", "reporting_period", F.lit(params_hash({"period": 31})).alias("params_hash"), "timestamp_start", F.lit("sma").alias("data_type"), (F.col("value") / 2).alias("value"), "version")
    return replace(base, data=base.data.unionByName(stored), objects=objects)


def other_source(catalog: Catalog) -> Catalog:
    """The catalog with a second source beside the aggregated one, whose closes are twice as high."""
    other = catalog.data.filter("data_type = 'close'").withColumns({"params_hash": F.lit(params_hash_for_source("other")), "value": F.col("value") * 2, "version": F.col("version") + 1})
    return replace(catalog, data=catalog.data.unionByName(other))


def lagging(catalog: Catalog) -> Catalog:
    """The catalog without the last 120 hours of January of the coin error."""
    late = (F.col("asset") == F.xxhash64(F.lit("error"))) & (F.col("timestamp_start") >= START + 600 * HOUR)
    return replace(catalog, data=catalog.data.filter(~late))


def rounded(df: DataFrame) -> DataFrame:
    """Values to six places, without those that are no number."""
    value = F.col("value").cast("double")
    return df.filter(~F.isnan(value)).withColumn("value", F.round(value, 6))


def query(expr: str, period: str = "1h", **more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = Request(expr, more.get("assets"), PARAMS, limit=more.get("limit"), after_ts=more.get("after_ts", -1), publish_from=more.get("publish_from"))
        catalog = more.get("catalog", lambda c: c)(event_catalog(spark, sf_dir, period))
        return rounded(execute(catalog, request))

    return run


def over(n: int) -> str:
    return f"OVER (PARTITION BY coin, seg ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = "OVER (PARTITION BY coin, seg ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SEG = "OVER (PARTITION BY coin, seg ORDER BY t)"


def wilder(items: str, n: int) -> str:
    return f"CASE WHEN len({items}) > {n} THEN list_reduce(list_prepend(list_avg({items}[2:{n + 1}]), {items}[{n + 2}:]), lambda a, x: (a * {n - 1} + x) / {n}) END"


def sql(members: dict[str, tuple], period: str = "1h", low: str = "min_t", high: str = "max_t", lookback: int = 1, where: str = "true") -> str:
    """members: value, version and warm-up over the columns of `steps`."""
    step = INTERVALS[period]
    rows = "\nUNION ALL ".join(f"SELECT coin, '{name}' AS indicator, t, ({m[0]})::DOUBLE AS value, ({m[1] if len(m) > 1 else 'version'})::BIGINT AS version, ({m[2] if len(m) > 2 else 'true'}) AS warmup_complete FROM steps" for name, m in members.items())
    return f"""
WITH bars AS (
    SELECT event_type AS coin, (epoch_ms(ts) // {step}) * {step} AS t, arg_min(value, {{'t': ts, 'e': event_id}}) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, {{'t': ts, 'e': event_id}}) AS close, max(event_id) AS version
    FROM events GROUP BY 1, 2),
limits AS (SELECT {low} AS lo, {high} AS hi FROM (SELECT min(t) AS min_t, max(t) AS max_t FROM bars)),
scanned AS (SELECT bars.*, lo, hi FROM bars, limits WHERE t BETWEEN lo - {lookback * step} AND hi),
seg AS (SELECT *, t - (row_number() OVER (PARTITION BY coin ORDER BY t) - 1) * {step} AS seg FROM scanned),
bench AS (SELECT t, close AS bench_close, bench_ret FROM (
    SELECT t, close, CASE WHEN close > 0 AND lag(close) OVER (ORDER BY t) > 0 THEN close / lag(close) OVER (ORDER BY t) - 1 END AS bench_ret FROM scanned WHERE coin = 'view')
    WHERE bench_ret IS NOT NULL),
lagged AS (SELECT seg.*, bench_close, bench_ret, lag(close) {SEG} AS pc FROM seg LEFT JOIN bench USING (t)),
moved AS (SELECT *, CASE WHEN close > 0 AND pc > 0 AND abs(close / pc - 1) <= 5 THEN close / pc - 1 END AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM lagged),
steps AS (SELECT *, list(close) {SO_FAR} AS closes, list(tr) {SO_FAR} AS trs, list(greatest(close - pc, 0)) {SO_FAR} AS gains, list(greatest(pc - close, 0)) {SO_FAR} AS losses FROM moved),
members AS ({rows})
SELECT coin, indicator, t AS timestamp_start, t + {step} AS timestamp_end, round(value, 6) AS value, version, warmup_complete
FROM members, limits WHERE value IS NOT NULL AND NOT isnan(value) AND t BETWEEN lo AND hi AND {where}"""


def _windowed(f: str, n: int = 14) -> tuple[str, str, str]:
    return f.replace("#", over(n)), f"max(version) {over(n)}", f"count(*) {over(n)} >= {n}"


AVG14 = _windowed("avg(close) #")
EMA14 = ("CASE WHEN len(closes) >= 14 THEN list_reduce(list_prepend(list_avg(closes[1:14]), closes[15:]), lambda e, c: c * (2.0::DOUBLE / 15) + e * (1 - 2.0::DOUBLE / 15)) END", f"max(version) {over(14)}", "len(closes) >= 14")
ATR14 = (wilder("trs", 14), f"max(version) {over(14)}", "len(closes) >= 15")
_GAIN, _LOSS = wilder("list_transform(gains, lambda g: coalesce(g, 0))", 14), wilder("list_transform(losses, lambda g: coalesce(g, 0))", 14)
RSI14 = (f"CASE WHEN len(closes) > 14 THEN CASE WHEN ({_LOSS}) = 0 THEN CASE WHEN ({_GAIN}) > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + ({_GAIN}) / ({_LOSS})) END END", f"max(version) {over(14)}", "len(closes) >= 15")
SLOPE = _windowed("CASE WHEN NOT isnan(regr_slope(ret, bench_ret) #) THEN regr_slope(ret, bench_ret) # END", 31)
_FROM, _TO = str(PARAMS["from"]), str(PARAMS["to"])
_X = "close / 1000.5"
_MATH = {
    "abs": ("ABS(1 - [close.1h])", "abs(1 - close)"),
    "acos": ("ACOS(TANH([close.1h] / $scale))", f"acos(tanh({_X}))"),
    "acosh": ("ACOSH(1.5 + ABS([close.1h]))", "acosh(1.5 + abs(close))"),
    "asin": ("ASIN(TANH([close.1h] / $scale))", f"asin(tanh({_X}))"),
    "asinh": ("ASINH([close.1h])", "asinh(close)"),
    "atan": ("ATAN([close.1h])", "atan(close)"),
    "atanh": ("ATANH(0.5 * TANH([close.1h] / $scale))", f"atanh(0.5 * tanh({_X}))"),
    "cos": ("COS([close.1h])", "cos(close)"),
    "cosh": ("COSH([close.1h] / $scale)", f"cosh({_X})"),
    "greatest": ("GREATEST([close.1h], [open.1h], 50)", "greatest(close, open, 50)"),
    "power": ("POWER([close.1h], 2)", "power(close, 2)"),
    "sin": ("SIN([close.1h])", "sin(close)"),
    "sinh": ("SINH([close.1h] / $scale)", f"sinh({_X})"),
    "sqrt": ("SQRT(ABS([close.1h]))", "sqrt(abs(close))"),
    "tan": ("TAN([close.1h] / $scale)", f"tan({_X})"),
    "tanh": ("TANH([close.1h] / $scale)", f"tanh({_X})"),
}


def _last(first: int, last: int) -> dict:
    """Limits from the first-th to the last-th bar from the end."""
    return {"low": f"max_t - {(first - 1) * HOUR}", "high": f"max_t - {(last - 1) * HOUR}"}


def _count(first: int, bars_: int, lookback: int) -> dict:
    low = f"min_t + {(lookback + first - 2) * HOUR}"
    return {"low": low, "high": f"least(max_t, {low} + {(bars_ - 1) * HOUR})"}


#: name: (query, SQL)
ALL: dict[str, tuple[Callable, str]] = {
    "avg": (query("AVG([close.1h], 14)"), sql({"value": AVG14}, lookback=14)),
    "avg_daily": (query("AVG([close.1d], $period)", "1d"), sql({"value": AVG14}, "1d", lookback=14)),
    "count": (query("COUNT([close.1h], 14)"), sql({"value": _windowed("count(*) #")}, lookback=14)),
    "var": (query("VAR([close.1h], t-($period-1), t)"), sql({"value": _windowed("avg(close * close) # - avg(close) # * avg(close) #")}, lookback=14)),
    "std": (query("STD([close.1h], t-13, t)"), sql({"value": _windowed("sqrt(greatest(0, avg(close * close) # - avg(close) # * avg(close) #))")}, lookback=14)),
    "regr_benchmark": (query("REGR(RET([close.1h@self]), RET([close.1h@$bench]), 31)"), sql({"value": SLOPE}, lookback=31)),
    "regr_slope_range": (query("REGR_SLOPE([close.1h; $from:$to], [open.1h; $from:$to], 31)"), sql({"value": _windowed("CASE WHEN NOT isnan(regr_slope(close, open) #) THEN regr_slope(close, open) # END", 31)}, low=_FROM, high=_TO, lookback=31)),
    "ret": (query("RET([close.1h])"), sql({"value": ("ret",)})),
    "ret_of_expression": (query("RET([close.1h] * 2)"), sql({"value": ("ret",)})),
    "benchmark_close": (query("[close.1h@self] - [close.1h@view]"), sql({"value": ("close - bench_close",)})),
    "benchmark_ret": (query("RET([close.1h@view]) + 0 * [close.1h@self]"), sql({"value": ("bench_ret + 0 * close",)})),
    "true_range": (query("TR([candle.1h])"), sql({"value": ("tr", "version", "pc IS NOT NULL")})),
    "ohlc_series": (query("([high.1h] + [low.1h]) / 2 - [open.1h]"), sql({"value": ("(high + low) / 2 - open",)})),
    "ema": (query("EMA([close.1h], 14)"), sql({"value": EMA14}, lookback=14)),
    "ema_padded": (query("EMA([close.1h; $from:$to], 14)"), sql({"value": EMA14}, low=_FROM, high=_TO, lookback=14)),
    "atr": (query("RMA(TR([candle.1h]), 14)"), sql({"value": ATR14}, lookback=15)),
    "rsi": (query("RSI([close.1h], 14)"), sql({"value": RSI14}, lookback=15)),
    "separation_over_atr": (query("([close.1h] - AVG([close.1h], 14)) / RMA(TR([candle.1h]), 14)"), sql({"value": (f"(close - {AVG14[0]}) / ({ATR14[0]})", f"greatest(version, {AVG14[1]})", "len(closes) >= 15")}, lookback=15)),
    "volatility": (query("STD(RET([close.1h]), $n) * SQRT($bars_per_year)"), sql({"value": (f"sqrt(greatest(0, avg(ret * ret) {over(24)} - avg(ret) {over(24)} * avg(ret) {over(24)})) * sqrt(8760)", *_windowed("", 24)[1:])}, lookback=24)),
    "precedence": (query("[close.1h] + 2 * (3 - [close.1h]) / 4.5"), sql({"value": ("close + 2 * (3 - close) / 4.5::DOUBLE",)})),
    "integer_division": (query("7 / 2 + COUNT([close.1h], 5) / 2 + 0 * [close.1h]"), sql({"value": (f"7 // 2 + (count(*) {over(5)}) // 2 + 0 * close", f"greatest(max(version) {over(5)}, version)", f"count(*) {over(5)} >= 5")}, lookback=5)),
    "math_functions": (query("{" + ", ".join(f"{k}: {v[0]}" for k, v in _MATH.items()) + "}"), sql({k: (v[1],) for k, v in _MATH.items()})),
    "nested_windows": (query("AVG(RET([high.1h]), 5)"), sql({"value": (f"avg(r) {over(5)}", f"max(version) {over(5)}", f"count(*) {over(5)} >= 5")}, lookback=5).replace("members AS (", f"ratio AS (SELECT *, lag(high) {SEG} AS ph FROM steps), rs AS (SELECT *, CASE WHEN high > 0 AND ph > 0 AND abs(high / ph - 1) <= 5 THEN high / ph - 1 END AS r FROM ratio), members AS (").replace("FROM steps),\nSELECT", "FROM rs)\nSELECT").replace("AS warmup_complete FROM steps)", "AS warmup_complete FROM rs)")),
    "domain_absolute": (query("AVG([close.1h], 14)[$from:$to]"), sql({"value": AVG14}, low=_FROM, high=_TO, lookback=14)),
    "domain_latest": (query("AVG([close.1h; 100@latest], 14)"), sql({"value": AVG14}, **_last(100, 1), lookback=14)),
    "domain_count_at_end": (query("AVG([close.1h; $n@$end], 14)"), sql({"value": AVG14}, low=str(PARAMS["end"] - 23 * HOUR), high=str(PARAMS["end"]), lookback=14)),
    "slice_last_bar": (query("AVG([close.1h], 14)[-3]"), sql({"value": AVG14}, **_last(3, 3), lookback=14)),
    "slice_nth_bar": (query("AVG([close.1h], 14)[4]"), sql({"value": AVG14}, **_count(4, 1, 14), lookback=14)),
    "slice_tail": (query("AVG([close.1h], 14)[-50:-11]"), sql({"value": AVG14}, **_last(50, 11), lookback=14)),
    "slice_head": (query("AVG([close.1h], 14)[:40]"), sql({"value": AVG14}, **_count(1, 40, 14), lookback=14)),
    "slice_middle": (query("AVG([close.1h], 14)[5:30]"), sql({"value": AVG14}, **_count(5, 26, 14), lookback=14)),
    "slice_from": (query("AVG([close.1h], 14)[20:]"), sql({"value": AVG14}, low=f"min_t + {32 * HOUR}", lookback=14)),
    "slice_last_n": (query("AVG([close.1h], 14)[-20:]"), sql({"value": AVG14}, **_last(20, 1), lookback=14)),
    "slice_until": (query("AVG([close.1h], 14)[:-20]"), sql({"value": AVG14}, high=f"max_t - {19 * HOUR}", lookback=14)),
    "slice_of_slice": (query("AVG([close.1h; $from:$to], 14)[11:][-100:-51]"), sql({"value": AVG14}, low=f"{PARAMS['to'] - 99 * HOUR}", high=f"{PARAMS['to'] - 50 * HOUR}", lookback=14)),
    "batch": (query("{sma: AVG([close.1h], 14), atr: RMA(TR([candle.1h]), 14), rsi: RSI([close.1h], 14), ema: EMA([close.1h], 14)}[$from:$to]"), sql({"sma": AVG14, "atr": ATR14, "rsi": RSI14, "ema": EMA14}, low=_FROM, high=_TO, lookback=15)),
    "page_limit": (query("[close.1h]", limit=16, after_ts=START + 50 * HOUR), sql({"value": ("close",)}, where=f"t > {START + 50 * HOUR} AND t <= (SELECT max(t) FROM (SELECT DISTINCT t FROM bars WHERE t > {START + 50 * HOUR} ORDER BY t LIMIT 16))")),
    "publish_from": (query("[close.1h]", publish_from=START + 600 * HOUR, assets=["view", "click"]), sql({"value": ("close",)}, where=f"t >= {START + 600 * HOUR} AND coin IN ('view', 'click')")),
    "object_field": (query("[ohlc.1h->high]"), sql({"value": ("high",)})),
    "object_range": (query("{close: [ohlc.1h->close; $from:$to], low: [ohlc.1h->low; $from:$to]}"), sql({"close": ("close",), "low": ("low",)}, low=_FROM, high=_TO)),
    "stored_scalar": (query("[sma.1h{period:31}]"), sql({"value": ("close / 2",)})),
    "source_avg": (query("AVG([other:close.1h], 14)", catalog=other_source), sql({"value": ("2 * (" + AVG14[0] + ")", "1 + " + AVG14[1], AVG14[2])}, lookback=14)),
    "source_true_range": (query("TR([other:candle.1h])", catalog=other_source), sql({"value": ("greatest(high - low, abs(high - 2 * pc), abs(low - 2 * pc))", "version + 1", "pc IS NOT NULL")})),
    "source_beside": (query("AVG([close.1h], 14)", catalog=other_source), sql({"value": AVG14}, lookback=14)),
    "batch_widest_window": (query("{a: AVG([close.1h], t0, t), b: AVG([close.1h], 20)}"), sql({"a": _windowed("avg(close) #", 20), "b": _windowed("avg(close) #", 20)}, lookback=20)),
    "slice_all": (query("AVG([close.1h], 14)[:]"), sql({"value": AVG14}, lookback=14)),
    "lagging_coin": (query("AVG([close.1h; 150@latest], 14)", catalog=lagging), sql({"value": AVG14}, **_last(150, 1), lookback=14).replace("seg AS (", f"ahead AS (SELECT * FROM scanned WHERE coin IS DISTINCT FROM 'error' OR t < {START + 600 * HOUR}),\nseg AS (", 1).replace("AS seg FROM scanned", "AS seg FROM ahead", 1)),
}


def object_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole objects; the text's numbers are compared."""
    rows = execute(event_catalog(spark, sf_dir), Request("[ohlc.1h]", None, PARAMS, limit=None))
    low, high = (F.get_json_object("value", f"$.{c}").cast("double") for c in ("low", "high"))
    return rows.withColumn("value", F.round(high - low, 6))


ALL["object_text"] = (object_text, sql({"value": ("high - low",)}))


def kernel(make: Callable[[Rolling, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Rows of the column k that make adds to the hourly bars, undefined ones too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(Rolling(("coin",), "timestamp_start"), event_bars(spark, sf_dir).filter("timestamp_start is not null"))
        return out.select("coin", "timestamp_start", F.round("k.value", 6).alias("value"), "k.version", F.col("k.warmup").alias("warmup"))

    return run


def kernel_sql(value: str, version: str = "version") -> str:
    """value over bars with pc and ph, the last close and high, rt, the return, and whole paths."""
    c = "(PARTITION BY coin ORDER BY t)"
    return sql({"value": ("close",)}).split("limits AS")[0] + f"""
before AS (SELECT *, lag(close) OVER {c} AS pc, lag(high) OVER {c} AS ph, row_number() OVER {c} AS nth FROM bars WHERE t IS NOT NULL),
rs AS (SELECT *, CASE WHEN high > 0 AND ph > 0 AND abs(high / ph - 1) <= 5 THEN high / ph - 1 END AS rt,
              CASE WHEN pc IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM before),
paths AS (SELECT *, list(close) OVER {c} AS closes, list(tr) OVER {c} AS trs, list(greatest(close - pc, 0)) OVER {c} AS gains, list(greatest(pc - close, 0)) OVER {c} AS losses FROM rs),
found AS (SELECT coin, t, ({value})::DOUBLE AS v, ({version})::BIGINT AS version FROM paths)
SELECT coin, t AS timestamp_start, round(v, 6) AS value, version, v IS NOT NULL AS warmup FROM found"""


def _gated(f: str, x: str, n: int) -> tuple[str, str]:
    w = f"OVER (PARTITION BY coin ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    full = f"count({x}) {w} = {n}"
    return f"CASE WHEN {full} THEN {f.replace('#', w)} END", f"CASE WHEN {full} THEN max(version) {w} ELSE version END"


def _seeded(value: str, first: int, many: int) -> tuple[str, str]:
    return value, f"CASE WHEN nth = {first} THEN max(version) OVER (PARTITION BY coin ORDER BY t ROWS BETWEEN {many - 1} PRECEDING AND CURRENT ROW) ELSE version END"


def _returns(k: Rolling, bars_: DataFrame) -> DataFrame:
    return bars_.withColumn("rt", k.ret(F.col("high"))["value"])


_SLOPE3 = "CASE WHEN max(open) # > min(open) # THEN regr_slope(close, open) # END"
KERNELS: dict[str, tuple[Callable, str]] = {
    "kernel_ret": (kernel(lambda k, b: b.withColumn("k", k.ret(F.col("high")))), kernel_sql("rt")),
    "kernel_tr": (kernel(lambda k, b: b.withColumn("k", k.tr(F.col("high"), F.col("low"), F.col("close")))), kernel_sql("tr")),
    "kernel_avg": (kernel(lambda k, b: _returns(k, b).withColumn("k", k.avg(F.col("rt"), 5))), kernel_sql(*_gated("avg(rt) #", "rt", 5))),
    "kernel_var": (kernel(lambda k, b: _returns(k, b).withColumn("k", k.var(F.col("rt"), 5))), kernel_sql(*_gated("avg(rt * rt) # - avg(rt) # * avg(rt) #", "rt", 5))),
    "kernel_std": (kernel(lambda k, b: _returns(k, b).withColumn("k", k.std(F.col("rt"), 5))), kernel_sql(*_gated("sqrt(greatest(0, avg(rt * rt) # - avg(rt) # * avg(rt) #))", "rt", 5))),
    "kernel_count": (kernel(lambda k, b: _returns(k, b).withColumn("k", k.count(F.col("rt"), 3))), kernel_sql(*_gated("3", "rt", 3))),
    "kernel_regr_slope": (kernel(lambda k, b: b.withColumn("k", k.regr_slope(F.col("close"), F.col("open"), 3))), kernel_sql(_gated(_SLOPE3, "close + open", 3)[0], _gated("", "close + open", 3)[1].replace("ELSE version", "ELSE 0"))),
    "kernel_ema": (kernel(lambda k, b: k.with_ema(b, "k", F.col("close"), 14)), kernel_sql(*_seeded(EMA14[0], 14, 14))),
    "kernel_atr": (kernel(lambda k, b: k.with_atr(b, "k", F.col("high"), F.col("low"), F.col("close"), 14)), kernel_sql(*_seeded(ATR14[0], 15, 15))),
    "kernel_rsi": (kernel(lambda k, b: k.with_rsi(b, "k", F.col("close"), 14)), kernel_sql(RSI14[0])),
}
ALL |= KERNELS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in ALL.items()}
