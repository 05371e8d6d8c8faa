"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from shoal.queries import clustering, kchoice, runs, separated, tables  # noqa: F401
from shoal.queries.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
