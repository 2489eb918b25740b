"""Queries of this library and their SQL, collected from the query modules."""

from __future__ import annotations

from nestra.operators import contracts, nested, streams, tables

MODULES: tuple = (nested, tables, contracts, streams)


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in MODULES:
        out |= module.SQL
    return out
