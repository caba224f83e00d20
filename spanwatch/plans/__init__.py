"""Registered queries and their SQL."""

from spanwatch.plans import scalar_queries, signal_queries, source_queries, stream_queries, structure_queries  # noqa: F401
from spanwatch.plans.registry import ORACLES, QUERIES  # noqa: F401
