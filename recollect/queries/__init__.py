"""All registered queries."""

from recollect.queries import facts, more, rest, scalars, search, streams  # noqa: F401
from recollect.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
