"""Registered queries over the test tables, each next to its SQL oracle."""

from creditloom.plans import (  # noqa: F401
    audit_queries,
    evaluate_queries,
    explain_queries,
    explore_queries,
    feature_queries,
    model_queries,
    source_queries,
    stream_queries,
)
from creditloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
