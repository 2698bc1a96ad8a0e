"""Registered queries over the driver tables, each beside its SQL."""

from __future__ import annotations

from agrolith.plans import draws, feeds, models, more, phenology, places, weather

MODULES = (weather, phenology, models, more, draws, feeds, places)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
