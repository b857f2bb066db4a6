"""Registered queries: importing this package registers every query module."""

from churnkit.plans import (account_queries, eval_queries, explain_queries, io_queries, ml_queries,  # noqa: F401
                            store_queries, stream_queries, usage_queries)
from churnkit.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
