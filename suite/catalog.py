"""All registered queries."""

from suite import q_scoring, q_sources, q_spatial  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
