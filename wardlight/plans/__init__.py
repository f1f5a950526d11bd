"""Named queries over the test tables, each next to the SQL that checks it."""

from wardlight.plans import association_queries, distribution_queries, model_queries, outcome_queries, score_queries, tables  # noqa: F401
from wardlight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
