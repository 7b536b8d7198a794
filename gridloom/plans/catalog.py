"""Every registered query of the raster and time-series operators, with its SQL."""

from __future__ import annotations

import importlib

from gridloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "composite_windows"

for _module in ("cells", "relations", "evaluation", "series", "lattice", "simulation", "storage", "learning", "evidence", "frames"):
    importlib.import_module(f"gridloom.plans.{_module}")

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
