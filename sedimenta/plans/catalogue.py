"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from sedimenta.plans import drifting, feeds, generic, lakehouse, streams

MODULES = [feeds, drifting, lakehouse, generic, streams]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
