"""All registered queries."""

from outings.plans import (  # noqa: F401
    aggregates, candidates, inference, landing, mutations, ranking, scalars, streams, vectors,
)
from outings.plans.registry import QUERIES

__all__ = ["QUERIES"]
