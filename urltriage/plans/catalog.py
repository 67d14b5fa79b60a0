"""All registered queries."""

from urltriage.plans import domain_queries, page_queries, search_queries  # noqa: F401
from urltriage.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
