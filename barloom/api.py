"""JSON requests and responses, and rows as dictionaries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame

from barloom.operators.engine import Plan, Request, execute, plan
from barloom.plans.domain import Absolute, FromStart, Full, Latest
from barloom.plans.errors import QueryError
from barloom.plans.syntax import Query, parse
from barloom.sources.catalog import Catalog

_FIELDS = {"expr", "reporting_period", "assets", "params", "after_ts", "limit", "publish_from", "obj_data_types", "scalar_data_types"}


def request_from_json(text: str) -> Request:
    try:
        body = json.loads(text)
        if not isinstance(body, dict) or not isinstance(body.get("expr"), str) or not isinstance(body.get("assets"), list):
            raise ValueError("`expr` and `assets` are required")
        params = body.get("params") or {}
        if any(isinstance(v, bool) or not isinstance(v, (int, float, str)) for v in params.values()):
            raise ValueError("params must be numbers or strings")
        return Request(
            expr=body["expr"],
            assets=body["assets"],
            params=params,
            reporting_period=body.get("reporting_period"),
            after_ts=body.get("after_ts", -1),
            limit=body.get("limit", 16),
            publish_from=body.get("publish_from"),
            object_types=frozenset(body.get("obj_data_types", ())),
            scalar_types=frozenset(body.get("scalar_data_types", ())),
        )
    except (ValueError, TypeError, AttributeError) as e:
        raise QueryError("parse_error", f"invalid compile request JSON: {e}") from e


def describe(p: Plan) -> dict:
    a = p.analysis
    match a.domain:
        case Full():
            domain = {"kind": "full"}
        case Absolute(f, t):
            domain = {"kind": "absolute", "from_ms": f, "to_ms": t}
        case Latest(b, o):
            domain = {"kind": "trailing_latest", "bars": b, "end_offset": o}
        case FromStart(s, c):
            domain = {"kind": "from_start", "start": s, "count": c}
    out = {
        "ok": True,
        "expr": p.request.expr,
        "path": p.path,
        "reporting_period": a.period,
        "interval_ms": a.interval,
        "params_hash": a.params_hash,
        "domain": domain,
        "indicators": list(p.query.members),
        "max_lookback": a.lookback,
        "market_tickers": a.tickers,
        "binds": {
            "coins": p.request.assets,
            "emit_from": a.domain.start if isinstance(a.domain, Absolute) else None,
            "emit_to": a.domain.end if isinstance(a.domain, Absolute) else None,
            "after_ts": p.request.after_ts,
            "limit": p.request.limit,
            "publish_from": p.request.publish_from,
            "max_lookback": a.lookback,
            "indicators": list(p.query.members),
        },
    }
    return out if a.source is None else out | {"source": a.source}


def compile_json(text: str) -> str:
    """Check a request; what it means, or the error."""
    try:
        return json.dumps(describe(plan(request_from_json(text))), ensure_ascii=False)
    except QueryError as e:
        return json.dumps({"ok": False, "error": e.as_dict()}, ensure_ascii=False)


def compile_file(path: str | Path) -> str:
    return compile_json(Path(path).read_text(encoding="utf-8"))


def parse_expr(text: str):
    """The one expression of a text; a batch is an error."""
    query = parse(text)
    if query.batch:
        raise QueryError("parse_error", "a batch is not an expression", text, 0)
    return query.members["value"]


def parse_batch(text: str) -> Query:
    """The members of a text, be it a batch or one expression."""
    return parse(text)


def compile_batch(request: Request, query: Query) -> Plan:
    """What a request means for a query that is parsed already."""
    return plan(request, query=query)


def compile_expr(request: Request, expr) -> Plan:
    return compile_batch(request, Query({"value": expr}))


def mapped_rows(df: DataFrame, path: str = "computed") -> Iterator[dict]:
    """Rows with exactly one of value and object; streamed, a partition at a time.

    Computed and raw series have numbers. Rows of an object series without a field must
    hold a JSON object; a field's text is a value as it stands.
    """
    for r in df.toLocalIterator():
        row = r.asDict()
        value = row.pop("value")
        if value is None:
            raise QueryError("compile_error", "a result row has no value")
        if path == "object":
            try:
                value = json.loads(value)
            except ValueError as e:
                raise QueryError("compile_error", f"invalid object JSON in value: {e}") from e
            if not isinstance(value, dict):
                raise QueryError("compile_error", "object payload must be a JSON object")
        elif path == "field":
            with suppress(ValueError):
                value = json.loads(value)
        else:
            value = float(value)
        yield row | ({"object": value} if isinstance(value, dict) else {"value": value})


def _mapping(p: Plan) -> str:
    """How a plan's values are read: as numbers, as whole objects, or as fields of objects."""
    whole = any(getattr(m, "item", None) is None for m in p.query.members.values())
    return "object" if p.path == "object" and whole else "field" if p.path == "object" else "computed"


def execute_json(catalog: Catalog, text: str) -> str:
    """Run a request; its rows, or the error."""
    try:
        request = request_from_json(text)
        rows = mapped_rows(execute(catalog, request), _mapping(plan(request, catalog)))
        return json.dumps({"ok": True, "rows": list(rows)}, ensure_ascii=False)
    except QueryError as e:
        return json.dumps({"ok": False, "error": e.as_dict()}, ensure_ascii=False)
