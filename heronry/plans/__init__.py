"""The registry: every query with its function and, where SQL can say it, its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["reference_queries", "text_queries", "telemetry_queries", "retrieval_queries", "refine_queries", "lifecycle_queries", "session_queries", "structure_queries", "chapter_queries", "search_queries", "evaluate_queries", "stream_queries", "relational_queries"]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"heronry.plans.{name}").QUERIES)
    return out
