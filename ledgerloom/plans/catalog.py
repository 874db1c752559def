"""All queries of the core library and their oracle SQL."""

from __future__ import annotations

from ledgerloom.plans import export_queries, general_data, layout_queries, ledger_queries, part_queries

MODULES = [ledger_queries, layout_queries, export_queries, part_queries, general_data]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
