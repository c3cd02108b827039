"""Every operator as a query over the shipped tables, and the same in SQL where SQL can say it."""

from refloom.queries import control, evaluation, matching, runs, texts  # noqa: F401  they register their queries
from refloom.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
