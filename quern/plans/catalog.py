"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from quern.plans import arrays, frames, functions, tpch

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (tpch, frames, functions, arrays):
    for _name, (_run, _sql) in _part.PLANS.items():
        QUERIES[_name] = _run
        if _sql:
            ORACLES[_name] = _sql
