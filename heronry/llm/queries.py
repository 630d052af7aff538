"""The registry of this subpackage: query name -> (function, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["percentile_queries", "privacy_queries", "scan_queries", "splitting_queries", "leakage_queries", "mixing_queries", "abuse_queries"]

QUERIES: dict = {}
for _name in MODULES:
    QUERIES.update(import_module(f"heronry.llm.{_name}").QUERIES)
