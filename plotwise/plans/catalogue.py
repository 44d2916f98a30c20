"""All queries of the library, with the SQL that checks them."""

from __future__ import annotations

from plotwise.plans import aggregates, civic, joins, merges, records, shown, texts, whole

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (aggregates, joins, civic, records, texts, whole, merges, shown):
    QUERIES |= _module.q.queries
    ORACLE_SQL |= _module.q.sql
