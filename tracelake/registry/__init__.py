"""Named queries over the driver tables."""

from tracelake.registry import (  # noqa: F401
    context_queries,
    evidence_queries,
    fit_queries,
    graph_queries,
    retrieval_queries,
    rule_queries,
    source_queries,
    sequence_queries,
    split_queries,
)
from tracelake.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
