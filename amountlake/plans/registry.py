"""Every registered query of the library, with the SQL that checks it."""

from __future__ import annotations

from . import tags
from .amounts import ORACLE_SQL, QUERIES

FLAGSHIP = "q_grouped_rupees"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "tags"]
