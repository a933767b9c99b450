"""The operators bound to the star-schema tables, each with the SQL it must equal.

Tables play the parts of talks, ratings, utterances and embeddings; every query
reads its tables whole.
"""

from rostrum.bindings import (  # noqa: F401
    cohorts, features, files, learning, metrics, numbers, reports, survey, targets, text,
)
from rostrum.bindings.registry import oracle_sql, queries  # noqa: F401
