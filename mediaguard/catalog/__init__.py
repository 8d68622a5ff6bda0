"""Every query by its key, with the SQL that must give the same rows."""
from __future__ import annotations

from importlib import import_module

MODULES = ["aggregations", "scalars", "relational", "io", "transforms", "fitting", "streams"]


def load():
    """(queries, oracle SQL), both keyed by operator id."""
    for m in MODULES:
        import_module(f"mediaguard.catalog.{m}")
    from mediaguard.catalog.base import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
