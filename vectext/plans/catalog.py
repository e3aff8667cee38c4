"""All registered queries."""

from vectext.plans import (  # noqa: F401
    corpus_queries,
    explain_queries,
    job_queries,
    stream_queries,
    table_queries,
    vector_queries,
)
from vectext.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
