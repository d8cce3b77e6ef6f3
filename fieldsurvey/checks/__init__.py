"""Queries over the test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from fieldsurvey.checks import aggregates, cells, covers, files, fits, merges, tables
from fieldsurvey.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "cells", "covers", "files", "fits", "merges", "tables"]
