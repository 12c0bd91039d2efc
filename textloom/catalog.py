"""Named queries over the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

from textloom.plans import allocation, events, quality, relational, stats, text  # noqa: F401
from textloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
