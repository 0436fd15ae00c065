"""Registered queries and their SQL twins."""

from arealis.plans import models, more, places, shapes, small, streams, tables, wider  # noqa: F401  they register
from arealis.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
