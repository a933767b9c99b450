"""Operators for preparing training data, each bound to one of the corpus tables."""

from rostrum.llm.registry import oracle_sql, queries  # noqa: F401
from rostrum.llm import bound, bound_more  # noqa: F401  registers the queries
