"""Importing this module registers every query."""

from runcast.plans import (campaign_queries, choice_queries, design_queries, input_queries, model_queries,  # noqa: F401
                           stat_queries, workload_queries)
from runcast.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
