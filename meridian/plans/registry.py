"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from . import etl, evaluation, files, geometry, lexical, pipelines, retrieval  # noqa: F401
from .oracle import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
