"""Registered queries: each operator over the given tables, next to the SQL it must agree with."""

from __future__ import annotations

from canvass.plans.catalog import (  # noqa: F401 - importing registers the queries
    answers, clean, functions, harmonise, measures, model, reporting, shapes, storage,
)
from canvass.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
