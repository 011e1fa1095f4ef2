"""Every query of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import acquiring, acquisition, assessment, features, impacts, surfaces, systems

_PLANS = (surfaces, assessment, acquisition, features, acquiring, impacts, systems)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
