"""Registered queries, one per operator, and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "stencils", "lines", "images", "pictures")


def registered() -> tuple[dict, dict]:
    """Queries and checking SQL by operator name."""
    for name in MODULES:
        importlib.import_module(f"heliospark.catalog.{name}")
    from heliospark.catalog.inputs import ORACLES, QUERIES

    return QUERIES, ORACLES
