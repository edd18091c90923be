"""Accepted and rejected texts, domains, identities and kernels."""

import math

import numpy as np
import pytest

from barloom.api import compile_batch, compile_expr, compile_file, compile_json, parse_batch, parse_expr
from barloom.functions import intervals, kernels
from barloom.functions.kernels import Aligned
from barloom.operators import folds
from barloom.operators.engine import Request, plan
from barloom.plans import domain as d
from barloom.plans.errors import QueryError
from barloom.plans.syntax import parse

PARAMS = {"period": 14, "from": 1_700_000_000_000, "to": 1_700_086_400_000, "end": 1_700_086_400_000, "benchmark": "ETH", "bars_per_year": 8760.0, "name": "x"}


def made(expr, **more):
    return plan(Request(expr, ["BTC", "ETH"], PARAMS, **more))


@pytest.mark.parametrize(
    ("expr", "domain", "lookback"),
    [
        ("AVG([close.1d; $from:$to], $period)", d.Absolute(PARAMS["from"], PARAMS["to"]), 14),
        ("AVG([close.1d], $period)[$from:$to]", d.Absolute(PARAMS["from"], PARAMS["to"]), 14),
        ("AVG([close.1d; $from:$to], t-($period-1), t)", d.Absolute(PARAMS["from"], PARAMS["to"]), 14),
        ("AVG([close.1d], 14)[-1]", d.Latest(1, 0), 14),
        ("AVG([close.1d], 14)[-10:-1]", d.Latest(10, 0), 14),
        ("AVG([close.1d], 14)[4]", d.FromStart(4, 1), 14),
        ("AVG([close.1d; 100@latest], $period)", d.Latest(100, 0), 14),
        ("AVG([close.1d; 2@$end], 3)", d.Absolute(PARAMS["end"] - 86_400_000, PARAMS["end"]), 3),
        ("RMA(TR([candle.1d]), $period)", d.Full(), 15),
        ("RSI([close.1h], 14)[:]", d.Full(), 15),
        ("[close. 01 d] + [close.1d][-1]", d.Latest(1, 0), 1),
        ("REGR(RET([close.1h@BTC]), RET([close.1h@$benchmark]), 31)", d.Full(), 31),
        ("AVG([close.1d], t0, t)", d.Full(), 1),
        ("{b: EMA([close.1h], 3), a: [close.1h],}[$from:$to]", d.Absolute(PARAMS["from"], PARAMS["to"]), 3),
    ],
)
def test_accepted(expr, domain, lookback):
    p = made(expr)
    assert (p.analysis.domain, p.analysis.lookback) == (domain, lookback)


@pytest.mark.parametrize(
    ("expr", "code", "part"),
    [
        ("[close]", "parse_error", "bucket required"),
        ("AVG(close, 3)", "parse_error", "bare identifier"),
        ("[close.3d]", "parse_error", "unsupported reporting_period"),
        ("[close.1x]", "parse_error", "unknown bucket unit"),
        ("14.", "parse_error", "expected digit after decimal point"),
        ("#", "parse_error", "unexpected character"),
        ("[close.1d] [close.1d", "parse_error", "empty index|expected"),
        ("{a: [close.1d]}[-1]", "parse_error", "only an emit-range"),
        ("{a: [close.1d], a: [close.1d]}", "parse_error", "duplicate batch name"),
        ("[close.1d][$from:$to][$from:$to]", "parse_error", "only one level"),
        ("[sma.1h{}]", "parse_error", "expected param name"),
        ("[sma.1h{period}]", "parse_error", "expected `:` after param name"),
        ("[sma.1h{period:}]", "parse_error", "integer or identifier"),
        ("[sma.1h{p:1,p:2}]", "parse_error", "duplicate param key"),
        ("AVG([close.1d], )", "parse_error", "expected expression"),
        ("t + 1", "parse_error", "only legal as a lookback bound"),
        ("-1", "parse_error", "expected expression"),
        ("{}", "sem_error", "must contain at least one"),
        ("1 + 2", "sem_error", "at least one series"),
        ("[a:close.1d] + [b:close.1d]", "sem_error", "sources must match"),
        ("[close.1d] + [close.1h]", "sem_error", "buckets must match"),
        ("[close.1d{p:1}] + [close.1d]", "sem_error", "same identity"),
        ("TR([close.1d])", "sem_error", "candle identity"),
        ("AVG([candle.1d], 3)", "sem_error", "only valid as the argument to TR"),
        ("[volume.1d]", "sem_error", "not yet supported"),
        ("TANH([close.1d], $period)", "sem_error", "lookback window"),
        ("[close.1d] + [close.1d@ETH]", "sem_error", "more than one asset"),
        ("[cloze.1d]", "sem_error", r"unknown series \[cloze\]"),
        ("AVG([close.1d], $nope)", "sem_error", r"missing param `\$nope`"),
        ("[close.1d] * $name", "sem_error", "text param"),
        ("RSI([close.1d], 1)", "sem_error", r"RSI requires \$period >= 2"),
        ("AVG([close.1d], 0)", "sem_error", "period must be >= 1"),
        ("AVG([close.1d], $period+1)", "sem_error", "AVG expects"),
        ("AVG([close.1d], t, t)", "sem_error", "unsupported lookback pair"),
        ("[close.1d][0]", "sem_error", "`0` is illegal"),
        ("[close.1d][-1:3]", "sem_error", "mixed"),
        ("[close.1d][-1] + [close.1d]", "sem_error", "conflicting series domains"),
        ("{a: [close.1d][-1], b: [close.1d][-1]}", "sem_error", "conflicting series domains"),
        ("[close.1d; 0@latest]", "sem_error", "emit count"),
        ("[close.1d; $to:$from]", "sem_error", "domain requires"),
        ("RMA([close.1d], 3)", "compile_error", "RMA currently supports"),
        ("[close.1d->x]", "compile_error", "field accessor requires an object"),
    ],
)
def test_rejected(expr, code, part):
    with pytest.raises(QueryError, match=part) as e:
        made(expr)
    assert e.value.code == code


def test_requests_and_stored_series():
    stored = {"object_types": frozenset({"candles"}), "scalar_types": frozenset({"sma", "ema"})}
    assert made("[candles.1h->close]", **stored).path == "object"
    assert made("[sma.1h{period:31}]", **stored).analysis.params_hash == "c5269d3c45d8d87c159d3f57ff76b94ca5c53bfc4387b31e8ed680fd2f829e38"
    for expr, part in [("[candles.1h] + 1", "wrapped"), ("[sma.1h][-1]", "wrapped"), ("{a: [sma.1h], b: [close.1h]}", "mix raw"), ("{a: [candles.1h], b: [close.1h]}", "mix object"), ("{a: [sma.1h], b: [ema.1h]}", "same stem")]:
        with pytest.raises(QueryError, match=part):
            made(expr, **stored)
    with pytest.raises(QueryError, match="stored as both"):
        made("[sma.1h]", object_types=frozenset({"sma"}), scalar_types=frozenset({"sma"}))
    with pytest.raises(QueryError, match="conflicts"):
        made("[close.1h]", reporting_period="1d")
    with pytest.raises(QueryError, match="dirty_from"):
        plan(Request("[close.1h]", ["A"], {"dirty_from": 1}))
    for bad in (Request("[close.1h]", []), Request("[close.1h]", ["A"], limit=0)):
        with pytest.raises(QueryError, match="must be"):
            plan(bad)


def test_positions_are_bytes():
    with pytest.raises(QueryError) as e:
        parse("[close.1d] + é")
    assert e.value.pos == 13


def test_hashes():
    assert intervals.params_hash({}) == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    assert intervals.params_hash_for_source("binance") == "691508c082c9c6b7be0aaed0f8a914bca6e8b2333ffadd9b297f367d4e83aa87"
    assert intervals.params_hash({"period": 96}) == "5f544ae02055d958bbbb70f1018b5758e8025bc998c5f60d5c0d9118eb9b7e26"
    assert intervals.interval_ms("12h") == 43_200_000


DAY = 10


@pytest.mark.parametrize(
    ("domain", "pick", "want"),
    [
        (d.Absolute(0, 100), ("index", 3, None), d.Absolute(20, 20)),
        (d.Absolute(0, 100), ("index", -2, None), d.Absolute(90, 90)),
        (d.Absolute(0, 100), ("index", -50, None), d.Absolute(0, 0)),
        (d.Absolute(0, 100), ("slice", None, -3), d.Absolute(0, 80)),
        (d.Absolute(0, 100), ("slice", 5, None), d.Absolute(40, 100)),
        (d.Absolute(0, 100), ("index", 12, None), None),
        (d.Latest(10, 0), ("index", 3, None), d.Latest(1, 7)),
        (d.Latest(10, 2), ("slice", -4, -2), d.Latest(3, 3)),
        (d.Latest(10, 0), ("slice", None, -4), d.Latest(7, 3)),
        (d.Latest(10, 0), ("index", 11, None), None),
        (d.Latest(d.MOST, 0), ("index", 1, None), None),
        (d.FromStart(3, 10), ("slice", 2, 4), d.FromStart(4, 3)),
        (d.FromStart(3, 10), ("index", -1, None), d.FromStart(12, 1)),
        (d.FromStart(3, d.MOST), ("index", -1, None), None),
        (d.FromStart(3, 10), ("slice", None, -3), d.FromStart(3, 8)),
        (d.Full(), ("slice", None, -3), d.Latest(d.MOST, 2)),
        (d.Full(), ("slice", 3, -1), d.FromStart(3, d.MOST)),
    ],
)
def test_domains(domain, pick, want):
    if want is None:
        with pytest.raises(d.DomainError):
            d.narrowed(domain, d.selection(*pick), DAY)
    else:
        assert d.narrowed(domain, d.selection(*pick), DAY) == want


def aligned(*values):
    return Aligned(list(values), list(range(len(values))), [v is not None for v in values])


def test_kernels():
    up = aligned(*map(float, range(1, 21)))
    assert kernels.rolling_avg(up, 5).values[-1] == 18
    five = aligned(10.0, 12.0, 14.0, 16.0, 18.0)
    assert [f(five, 5).values[-1] for f in (kernels.rolling_avg, kernels.rolling_var, kernels.rolling_count)] == [14, 8, 5]
    assert math.isclose(kernels.rolling_std(five, 5).values[-1], math.sqrt(8))
    assert kernels.rolling_var(aligned(2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0), 8).values[-1] == 4
    assert kernels.ema_series(aligned(10.0, 12.0, 11.0, 15.0, 14.0, 16.0), 3).values[2:] == [11, 13, 13.5, 14.75]
    assert kernels.ema_series(aligned(None, None, 2.0, 2.0, 2.0, 2.0), 3).values == [None] * 4 + [2, 2]
    closes = [10.0, 11.0, 12.0, 13.0, 14.0, 16.0]
    atr = kernels.wilder_atr([c + 1 for c in closes], [c - 1 for c in closes], aligned(*closes), 3)
    assert atr.values[:3] == [None] * 3 and [round(v, 9) for v in atr.values[3:]] == [2, 2, round(7 / 3, 9)]
    assert kernels.tr_series([11.0, 13.0, 12.5], [9.0, 10.0, 10.5], aligned(10.0, 12.0, 11.0)).values == [None, 3, 2]
    assert kernels.wilder_rsi(aligned(*map(float, range(1, 7))), 3).values[-1] == 100
    assert kernels.wilder_rsi(aligned(*[100.0] * 6), 3).values[-1] == 50
    market = aligned(*[0.01 * (i % 4 - 1) for i in range(10)])
    assert math.isclose(kernels.rolling_regr_slope(market.map_unary(lambda v: 2 * v), market, 5).values[-1], 2)
    assert kernels.rolling_regr_slope(market, market, 5).versions[0] == 0
    assert kernels.ret_series(aligned(1.0, 7.0, None, 2.0, 3.0)).values == [None, None, None, None, 0.5]
    both = five.map_zip(aligned(1.0, None, 1.0, 1.0, 1.0), lambda a, b: a - b)
    assert both.values[1] is None and both.values[0] == 9
    with pytest.raises(ValueError):
        five.map_zip(up, lambda a, b: a)


def test_json(tmp_path):
    import json

    body = {"expr": "AVG([close.1d], $period)[-1]", "assets": ["BTC"], "params": {"period": 5}}
    out = json.loads(compile_json(json.dumps(body)))
    assert out["ok"] and out["domain"] == {"kind": "trailing_latest", "bars": 1, "end_offset": 0} and out["max_lookback"] == 5
    assert out["binds"]["limit"] == 16
    (tmp_path / "q.json").write_text(json.dumps(body | {"expr": "AVG("}))
    assert json.loads(compile_file(tmp_path / "q.json"))["error"]["code"] == "parse_error"
    assert json.loads(compile_json("{"))["error"]["code"] == "parse_error"


def test_kernels_are_warm_where_they_have_a_value():
    flat, rising = aligned(*[2.0] * 5), aligned(1.0, 2.0, 3.0, 4.0, 5.0)
    slope = kernels.rolling_regr_slope(rising, flat, 3)
    assert slope.values == [None] * 5 and slope.warmup == [False] * 5
    none = kernels.rolling_stat(rising, 2, lambda w: None if w[0] == 2 else w[0])
    assert none.values == [None, 1, None, 3, 4] and none.warmup == [False, True, False, True, True]
    assert kernels.rolling_regr_slope(rising, aligned(1.0, 2.0, 3.0), 2).values == [None, 1, 1]
    assert rising.map_zip(aligned(1.0, None, 1.0, 1.0, 1.0), max).warmup == [True, False, True, True, True]
    assert len(kernels.tr_series([2.0, 3.0], [1.0], rising).values) == 1


def test_smoothed_is_the_recurrence():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 200, 1000):
        for keep in (0.0, 0.5, 13 / 15):
            x, out = rng.standard_normal(n), []
            for v in x:
                out.append(keep * out[-1] + (1 - keep) * v if out else 0.3)
            assert np.allclose(kernels.smoothed(x, 0.3, keep), out, rtol=0, atol=1e-12)


def test_folds_are_the_kernels():
    rng = np.random.default_rng(1)
    for _ in range(40):
        x = rng.uniform(1, 9, int(rng.integers(0, 40)))
        x[rng.random(len(x)) < rng.choice([0, 0.1])] = np.nan
        listed = [None if np.isnan(v) else float(v) for v in x]
        for n in (1, 3, 14):
            for got, want in ((folds.ema(x, n, False), kernels.ema_values(listed, n)), (folds.wilder(x, n), kernels.wilder_values(listed, n)), (folds.rsi(x, n, False), kernels.rsi_values(listed, n))):
                assert np.allclose(got, [np.nan if v is None else v for v in want], atol=1e-9, equal_nan=True)


def test_parsed_forms():
    request = Request("AVG([close.1d], 14)", ["BTC"])
    expr = parse_expr(request.expr)
    assert compile_expr(request, expr) == plan(request) == compile_batch(request, parse_batch(request.expr))
    with pytest.raises(QueryError):
        parse_expr("{a: [close.1d]}")
    assert list(parse_batch("{b: [close.1d], a: [close.1d]}").members) == ["a", "b"]


def bars_of(domain, newest):
    """The bars (1 to newest) of a domain on a grid of one millisecond."""
    low, high = d.emit_bounds(domain, 1, newest, 1, 1)
    return list(range(low, high + 1))


@pytest.mark.parametrize("domain", [d.Full(), d.Absolute(3, 17), d.Latest(9, 0), d.Latest(9, 4), d.Latest(d.MOST, 0), d.Latest(d.MOST, 3), d.FromStart(1, 8), d.FromStart(4, 8), d.FromStart(4, d.MOST)])
def test_every_selection_of_a_domain(domain):
    """Slices pick what Python's slices of the bars pick; only open ends may refuse."""
    newest = 20
    bars = bars_of(domain, newest)
    n = len(bars)
    picks = [("index", i, None, bars[i - 1 if i > 0 else i :][:1]) for i in (*range(1, n + 1), *range(-n, 0))]
    picks += [("slice", None, i, bars[:i] if i > 0 else bars[: n + i + 1]) for i in (*range(1, n + 1), *range(-n, 0))]
    picks += [("slice", i, None, bars[i - 1 :] if i > 0 else bars[i:]) for i in (*range(1, n + 1), *range(-n, 0))]
    picks += [("slice", i, k, bars[i - 1 : k]) for i in range(1, n + 1) for k in range(i, n + 1)]
    picks += [("slice", i, k, bars[i : k + 1 or None]) for i in range(-n, 0) for k in range(i, 0)]
    refused = 0
    for kind, first, last, want in picks:
        try:
            got = d.narrowed(domain, d.selection(kind, first, last), 1)
        except d.DomainError:
            refused += 1
            assert d.MOST in (getattr(domain, "bars", 0), getattr(domain, "count", 0))
            continue
        assert bars_of(got, newest) == want, (kind, first, last)
    assert refused < len(picks)


@pytest.mark.parametrize("pick", [(0, None), (None, 0), (3, 2), (-2, -3), (1, -2), (-2, 1), (1 << 31, None)])
def test_selections_that_select_nothing(pick):
    with pytest.raises(d.DomainError):
        d.selection("slice", *pick)
