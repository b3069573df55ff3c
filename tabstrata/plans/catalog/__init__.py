"""Registered queries and their SQL counterparts, by operator family."""

from tabstrata.plans.catalog import describe, encoding, learning, searching

MODULES = (describe, encoding, learning, searching)


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
