"""Registered queries over the test tables, each with its SQL oracle where one can be written."""

from factlake.queries import (  # noqa: F401
    aggregates,
    dedup,
    graphs,
    inventories,
    joins,
    sources,
    texts,
    windows,
)
from factlake.queries.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
