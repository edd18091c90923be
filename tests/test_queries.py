"""Queries against DuckDB over the same tables, and cases made by hand."""

import json

import duckdb
import pytest

from pyspark.sql import functions as F

from barloom import queries
from barloom.api import execute_json, mapped_rows
from barloom.functions import kernels
from barloom.functions.columns import Rolling
from barloom.functions.kernels import Aligned
from barloom.operators import engine
from barloom.operators.engine import Request, execute
from barloom.plans.errors import QueryError
from barloom.sources.catalog import candles_from_json, catalog_of_bars, latest_versions

FOLDER = "/root/testdata/sf0.01"
KEYS = ["coin", "indicator", "timestamp_start"]


def compared(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(folder)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (t[sorted(want.columns)].sort_values([c for c in KEYS if c in want.columns]).reset_index(drop=True) for t in (got, want))
    assert len(got) == len(want) and got.equals(want.astype(got.dtypes.to_dict()))


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """Events a few microseconds apart at the edges of bars, other types, and nulls in every column."""
    folder = tmp_path_factory.mktemp("dense")
    start = queries.START * 1000
    duckdb.sql(f"""COPY (
        SELECT CASE WHEN i % 97 = 0 THEN NULL ELSE i END AS event_id,
               CASE WHEN i % 89 = 0 THEN NULL ELSE make_timestamp({start} + (i // 40) * 3600000000 + ((i * 7919) % 40) * 50 - 1000) END AS ts, i AS user_id,
               CASE i % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'new' WHEN 3 THEN NULL ELSE 'error' END AS event_type,
               CASE WHEN i % 11 = 0 THEN NULL WHEN i % 1013 = 0 THEN 'nan'::DOUBLE ELSE ((i * 31) % 997) / 8 + 1 END AS value, NULL::VARCHAR AS props
        FROM range(24000) r(i)) TO '{folder}/events.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["count", "precedence", "ohlc_series", "benchmark_close", "nested_windows", "slice_until", "stored_scalar", "integer_division"])
def test_ties_nulls_and_new_coins_against_sql(spark, dense, name):
    compared(spark, dense, name)


def test_bars_do_not_depend_on_the_session_zone(spark):
    name, zone = "slice_middle", spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        compared(spark, FOLDER, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("name", ["avg", "std", "regr_benchmark", "true_range", "ema_padded", "separation_over_atr", "rsi", "integer_division", "math_functions", "slice_middle", "batch", "page_limit", "object_range", "stored_scalar", "source_avg", "source_true_range", "source_beside", "batch_widest_window", "slice_all", "lagging_coin", *queries.KERNELS])
def test_against_sql(spark, name):
    compared(spark, FOLDER, name)


@pytest.fixture(scope="module")
def catalog(spark):
    closes = [10.0, 12.0, 11.0, None, 15.0, 14.0, 16.0]
    rows = [("A", i * 60_000, c, c, c, c, 1.0, i) for i, c in enumerate(closes)] + [("B", i * 60_000, float(i), i + 1.0, i - 1.0, float(i), 1.0, i) for i in (0, 1, 2, 4, 5, 6)]
    return catalog_of_bars(spark.createDataFrame(rows, "coin string, timestamp_start long, open double, high double, low double, close double, volume double, version long"), "1m")


def values(catalog, expr, coins=("B",), **more):
    return [(r.timestamp_start // 60_000, r.value, r.warmup_complete) for r in execute(catalog, Request(expr, list(coins), limit=None, **more)).collect()]


def test_gaps_start_segments(catalog):
    assert values(catalog, "COUNT([close.1m], 2)") == [(0, 1.0, False), (1, 2.0, True), (2, 2.0, True), (4, 1.0, False), (5, 2.0, True), (6, 2.0, True)]


def test_nulls_in_windows(catalog):
    assert values(catalog, "AVG([close.1m], 2)", "A")[3] == (3, 11.0, True)
    assert [v[0] for v in values(catalog, "EMA([close.1m], 2)", "A")] == [1, 2]


def test_fold_over_an_argument(catalog):
    assert values(catalog, "EMA([high.1m], 2)")[0] == (1, 1.5, True)
    assert values(catalog, "EMA(EMA([close.1m], 2), 2)")[0] == (2, 1.0, True)


def test_strict_domain_and_division(catalog):
    with pytest.raises(Exception, match="SQRT"):
        values(catalog, "SQRT(0 - 1 - [close.1m])")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|by zero"):
        values(catalog, "1 / [close.1m]")


def test_unknown_coin_and_json(catalog):
    assert values(catalog, "[close.1m]", ["Z"]) == []
    out = json.loads(execute_json(catalog, json.dumps({"expr": "[close.1m][-1]", "assets": ["B"]})))
    assert out["rows"] == [{"coin": "B", "indicator": "value", "timestamp_start": 360_000, "timestamp_end": 420_000, "version": 6, "warmup_complete": True, "value": 6.0}]


def test_catalog_helpers(spark, catalog):
    twice = catalog.data.unionByName(catalog.data.selectExpr("asset", "reporting_period", "params_hash", "timestamp_start", "data_type", "value + 1 AS value", "version + 1 AS version"))
    assert latest_versions(twice).count() == catalog.data.count()
    rows = [(1, "1m", "h", 0, '{"high": 2, "low": 1}', 1), (1, "1m", "h", 1, '{"candles": [{"high": 3.5}]}', 1)]
    got = candles_from_json(spark.createDataFrame(rows, "asset long, reporting_period string, params_hash string, timestamp_start long, value string, version long")).collect()
    assert [(r.high, r.low) for r in got] == [(2.0, 1.0), (3.5, None)]


def mapped(spark, path, *values):
    return list(mapped_rows(spark.createDataFrame([(v,) for v in values], "value string"), path))


def test_rows_are_mapped_by_path(spark):
    assert mapped(spark, "object", '{"a": 1}') == [{"object": {"a": 1}}]
    for bad in ("[1]", "1", "{"):
        with pytest.raises(QueryError):
            mapped(spark, "object", bad)
    assert mapped(spark, "field", "2.5", "x") == [{"value": 2.5}, {"value": "x"}]
    assert mapped(spark, "raw", "2.5") == [{"value": 2.5}]
    with pytest.raises(QueryError):
        mapped(spark, "raw", None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, catalog):
    """Candles are cut to the coins, benchmarks broadcast, pages found in one pass."""
    text = plan_of(execute(catalog, Request("TR([candle.1m])", ["A"], limit=None)))
    assert "LeftSemi" in text
    text = plan_of(execute(catalog, Request("REGR(RET([close.1m@self]), RET([close.1m@B]), 2)", ["A"], limit=None)))
    assert "SortMergeJoin" not in text
    text = plan_of(execute(catalog, Request("EMA([close.1m], 2)", ["A", "B"], limit=3)))
    assert text.count("FlatMapGroupsInPandas") == 1 and "WindowGroupLimit" in text


def test_pages_by_rank_and_by_join_agree(spark, catalog, monkeypatch):
    request = Request("AVG([close.1m], 2)", ["A", "B"], limit=2, after_ts=60_000)
    ranked = execute(catalog, request).collect()
    monkeypatch.setattr(engine, "MOST_RANKED", 0)
    assert execute(catalog, request).collect() == ranked and len({r.timestamp_start for r in ranked}) == 2


def test_kernel_columns_follow_the_kernels(spark):
    rows = [("a", i, None if i in (4, 11) else float((i * 7) % 5 + 1), i * 3 % 10) for i in range(25)] + [("b", i, float(i), i) for i in range(4)]
    df = spark.createDataFrame(rows, "s string, i long, x double, version long")
    k = Rolling(("s",), "i")
    x = F.col("x")
    for n in (0, 1, 3):
        out = df.withColumns({"avg": k.avg(x, n), "count": k.count(x, n), "slope": k.regr_slope(x, x * x, n)})
        out = k.with_rsi(k.with_ema(out, "ema", x, n), "rsi", x, n)
        out = k.with_atr(out, "atr", x + 1, x - 1, x, n)
        got = {}
        for r in sorted(out.collect(), key=lambda r: (r.s, r.i)):
            got.setdefault(r.s, []).append(r)
        for s in ("a", "b"):
            own = [r for r in rows if r[0] == s]
            series = Aligned([r[2] for r in own], [r[3] for r in own], [True] * len(own))
            up, down = ([None if v is None else v + d for v in series.values] for d in (1, -1))
            want = {"avg": kernels.rolling_avg(series, n), "count": kernels.rolling_count(series, n), "slope": kernels.rolling_regr_slope(series, series.map_unary(lambda v: v * v), n), "ema": kernels.ema_series(series, n), "rsi": kernels.wilder_rsi(series, n), "atr": kernels.wilder_atr(up, down, series, n)}
            for name, w in want.items():
                col = [r[name] for r in got[s]]
                assert [c.value is None for c in col] == [v is None for v in w.values], (name, n)
                assert all(v is None or abs(c.value - v) < 1e-9 for c, v in zip(col, w.values, strict=True)), (name, n)
                assert [c.warmup for c in col] == w.warmup, (name, n)
                if n or name != "slope":
                    assert [c.version for c in col] == w.versions, (name, n)
    assert k.with_ema(df.limit(0), "ema", x, 3).count() == 0
