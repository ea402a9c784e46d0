"""The registered queries of the library, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from .plans import audits, bi, documents, elements, extras, grids, intake, pieces, records, structure, summaries, usage, workspace  # noqa: F401  each registers its queries
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "ranked_bar"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
