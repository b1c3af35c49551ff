"""All registered queries (importing the modules registers them)."""

from graphloom.registry import code_queries, flagship, graph_queries, impact_queries, index_queries, plan_queries, stream_queries, traverse_queries  # noqa: F401
from graphloom.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
