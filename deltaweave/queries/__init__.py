"""Named queries over the shared tables, each with its SQL."""

from deltaweave.queries import apps, batch, incremental  # noqa: F401
from deltaweave.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
