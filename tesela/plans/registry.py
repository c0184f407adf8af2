"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from tesela.plans import aggregates, extras, indices, networks, predicates, records, sources, streams, vectors

MODULES = (records, aggregates, indices, predicates, networks, vectors, sources, streams, extras)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
