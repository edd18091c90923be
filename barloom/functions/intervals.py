"""Bar lengths and the identity of a stored series."""

from __future__ import annotations

import hashlib
import json

# The reporting periods and their milliseconds.
INTERVALS = {
    "1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000,
    "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "12h": 43_200_000,
    "1d": 86_400_000, "1w": 604_800_000,
}


def interval_ms(period: str) -> int:
    if period not in INTERVALS:
        raise ValueError(f"unsupported reporting_period `{period}`")
    return INTERVALS[period]


def params_hash(identity: dict) -> str:
    """SHA-256 of the compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def params_hash_for_source(source: str | None) -> str:
    return params_hash({"source": source} if source else {})


def params_hash_for_identity(source: str | None, identity: dict) -> str:
    return params_hash(({"source": source} if source else {}) | identity)
