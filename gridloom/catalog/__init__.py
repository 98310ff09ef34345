"""Registered queries: each operator on whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from gridloom.catalog.base import ORACLES, QUERIES

from gridloom.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    grids,
    indexing,
    joins,
    masking,
    modelling,
    patching,
    sampling,
    storage,
    temporal,
    vectors,
)

__all__ = ["ORACLES", "QUERIES"]
