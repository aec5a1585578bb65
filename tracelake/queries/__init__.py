"""Registered queries: one function and, where SQL can say it, one oracle for each."""

from __future__ import annotations

from . import metrics, plans, runs, traces, vectors

_MODULES = (metrics, plans, traces, vectors, runs)
QUERIES = {name: run for module in _MODULES for name, run in module.register.queries.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.register.oracles.items()}
