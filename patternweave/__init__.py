"""Subgraph matching on Spark: patterns in one large undirected graph, by DataFrame joins and aggregates."""

from .graph import Graph
from .options import Options
from .plans.patterns import PATTERNS, Pattern

__all__ = ["PATTERNS", "Graph", "Options", "Pattern"]
