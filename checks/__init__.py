"""Every operator as a query over the provided tables, with the SQL it has to agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_sources", "q_joins", "q_profile", "q_cleaning", "q_frames", "q_splits", "q_metrics", "q_recipes"]


def load():
    """All queries and their SQL."""
    for name in MODULES:
        import_module(f"checks.{name}")
    from checks.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
