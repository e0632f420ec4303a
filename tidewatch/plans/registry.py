"""All core queries and their SQL, by name."""

from __future__ import annotations

from tidewatch.plans import analytics, code, history, reports, snapshots, supply

_MODULES = (snapshots, code, analytics, history, supply, reports)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
