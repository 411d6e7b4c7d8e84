"""Queries by name, each with the SQL that gives the same answer where SQL can."""

from . import library, scans, structures, tables

_MODULES = [library, structures, tables, scans]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.SQL)
